"""Running the batch operators on a stream of new documents."""
