"""Evidence-backed document risk analytics and corpus preparation on Spark."""
