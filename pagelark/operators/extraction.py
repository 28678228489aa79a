"""Values of two table rows (cash, operating cash flow) out of evidence pages.

For each evidence the page's lines are searched for the row label, the amounts below it are its columns, and the header
lines above it name the periods. Currency, unit and periods may come from the pages next to it. The candidates of a
metric are then ranked and the best is compared with the others. All but the header reader are column expressions, and a
page's neighbours are a window frame.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import amount, is_amount, is_dash
from ..functions.lexicon import CASH_LABELS, OPERATING_LABELS
from ..functions.periods import header
from ..functions.policy import PERIOD_MONTHS
from ..functions.text import lines

CASH, FLOW = "cash_and_cash_equivalents", "operating_cash_flow"
LABELS = {CASH: CASH_LABELS, FLOW: OPERATING_LABELS}
EXPECTED_INTENT = {CASH: "cash_flow_ending_cash", FLOW: "operating_cash_flow"}
CANDIDATES = 5

# What tells a currency and a unit.
CURRENCIES = {"CNY": r"(?iU)人民幣|人民币|\bRMB\b|\bCNY\b", "HKD": r"(?iU)港元|港幣|港币|HK\$|\bHKD\b", "USD": r"(?iU)美元|US\$|\bUSD\b"}
UNITS = {"thousand": r"(?iU)千元|['’]000|\bthousand\b", "ten_thousand": r"(?<!百)(?:萬元|万元)", "million": r"(?iU)百萬元|百万元|\bmillion\b"}
SCALED = r"千元|萬元|万元|百萬元|百万元"
PLAIN_UNIT = r"(?iU)(?<!千)(?<!萬)(?<!万)(?<!百)元|\bunit\b"


def _named(pairs) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]), lambda x: x.isNotNull())


#: What a text holds, in upper case, wherever the pattern of a name matches; looked for first, as that is far cheaper.
SIGNS = {
    "CNY": ("人民", "RMB", "CNY"), "HKD": ("港", "HK"), "USD": ("美元", "US$", "USD"), "thousand": ("千元", "000", "THOUSAND"),
    "ten_thousand": ("萬元", "万元"), "million": ("百萬元", "百万元", "MILLION"), "unit": ("元", "UNIT"),
}


#: Characters that match i and k whatever the case, but whose upper cases are others.
ODD_CASES = ("\u0130", "\u212a")


def _bound(text: Column) -> Column:
    """A text's upper case, and whether it holds one of the odd cases."""
    return F.struct(F.upper(text).alias("upper"), reduce(or_, (F.contains(text, F.lit(c)) for c in ODD_CASES)).alias("odd"))


def _signed(text: Column, name: str, bound: Column | None = None) -> Column:
    """Whether a text may hold the name."""
    bound = _bound(text) if bound is None else bound
    return reduce(or_, (F.contains(bound["upper"], F.lit(s)) for s in SIGNS[name]), bound["odd"])


def _told(text: Column, pairs) -> Column:
    """The names whose sign the text holds and whose test it passes; the text's upper case is found once for all of them."""
    named = lambda bound: _named((name, _signed(text, name, bound) & test) for name, test in pairs)
    return F.get(F.transform(F.array(_bound(text)), named), 0)


def currencies(text: Column) -> Column:
    """All currencies that a text mentions."""
    return _told(text, [(c, text.rlike(p)) for c, p in CURRENCIES.items()])


def units(text: Column) -> Column:
    """All units that a text mentions."""
    plain = F.regexp_replace(text, SCALED, "").rlike(PLAIN_UNIT)
    return _told(text, [*((u, text.rlike(p)) for u, p in UNITS.items()), ("unit", plain)])


def only(found: Column) -> Column:
    """The element of an array of one, else null."""
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def label_place(page_lines: Column, patterns: tuple[str, ...]) -> Column:
    """struct<priority, line, label> of the row label: the first pattern that any line holds, at its first line."""
    holds = lambda p: lambda line: line.rlike(p)
    hits = []
    for i, p in enumerate(patterns):
        at = F.array_position(F.transform(page_lines, holds(p)), F.lit(True))
        label = F.regexp_extract(F.element_at(page_lines, at.cast("int")), p, 0)
        hits.append(F.when(at > 0, F.struct(F.lit(i).alias("priority"), at.cast("int").alias("line"), label.alias("label"))))
    return F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull()))


def cells_below(page_lines: Column, line: Column) -> Column:
    """The amounts, or lone dashes, on the lines that follow a label without a break."""
    rest = F.slice(page_lines, line + 1, F.size(page_lines))
    stop = F.array_position(F.transform(rest, lambda s: is_dash(s) | is_amount(s)), F.lit(False)).cast("int")
    return F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest)


def latest_complete(periods: Column, cells: Column) -> Column:
    """struct<end, months, raw, value> of the latest column that has a value; of equal dates the first."""
    zipped = F.zip_with(
        periods, cells, lambda p, c: F.struct(p["end"].alias("end"), p["months"].alias("months"), c.alias("raw"), amount(c).alias("value"))
    )
    complete = F.filter(zipped, lambda z: z["value"].isNotNull())
    ranked = F.transform(complete, lambda z, i: F.struct(z["end"].alias("end"), (-i).alias("i"), z.alias("z")))
    best = F.array_max(F.transform(ranked, lambda r: F.struct(r["end"].alias("end"), r["i"].alias("i"))))
    chosen = F.element_at(complete, (1 - best["i"]).cast("int"))
    single = F.filter(F.transform(cells, lambda c: F.struct(c.alias("raw"), amount(c).alias("value"))), lambda c: c["value"].isNotNull())
    lone = F.struct(periods[0]["end"].alias("end"), periods[0]["months"].alias("months"), F.element_at(single, 1)["raw"].alias("raw"), F.element_at(single, 1)["value"].alias("value"))
    return F.when((F.size(periods) > 0) & (F.size(periods) == F.size(cells)), F.when(F.size(complete) > 0, chosen)).when(
        (F.size(single) == 1) & (F.size(periods) == 1), lone
    )


def neighbours(pages: DataFrame, payload: tuple[str, ...], document: str = "document_id", page: str = "page", chunk: str = "chunk_id", reach: int = 1) -> DataFrame:
    """pages with neighbours: array<struct<away, page, chunk_id, payload...>> of the other chunks within reach, nearest first."""
    around = Window.partitionBy(document).orderBy(page).rangeBetween(-reach, reach)
    one = F.struct(F.col(page).alias("page"), F.col(chunk).alias("chunk_id"), *payload)
    others = F.filter(F.collect_list(one).over(around), lambda o: o["chunk_id"] != F.col(chunk))
    away = F.transform(others, lambda o: F.struct(F.abs(o["page"] - F.col(page)).alias("away"), o["page"].alias("page"), o["chunk_id"].alias("chunk_id"), *[o[p].alias(p) for p in payload]))
    # payloads may not be comparable, so only the three leading fields order
    key = lambda o: F.struct(o["away"], o["page"], o["chunk_id"])
    ordered = F.array_sort(away, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    return pages.withColumn("neighbours", ordered)


def prepare_pages(chunks: DataFrame) -> DataFrame:
    """chunks with lines, currencies, units, the header that the whole page would be, and neighbours with the same."""
    text = F.col("text")
    read = (
        chunks.withColumn("lines", lines(text))
        .withColumn("currencies", currencies(text))
        .withColumn("units", units(text))
        .withColumn("page_header", header(F.col("lines")))
    )
    return neighbours(read, ("currencies", "units", "page_header"))


def _resolved_scale() -> dict[str, Column]:
    """Currency, unit, the chunks they come from, the reviewed chunks and issues, from the page and its neighbours."""
    own_c, own_u = only(F.col("currencies")), only(F.col("units"))
    several_c, several_u = F.size("currencies") > 1, F.size("units") > 1
    settled = (own_c.isNotNull() & own_u.isNotNull()) | several_c | several_u

    def judged(n: Column) -> Column:
        c, u = only(n["currencies"]), only(n["units"])
        issue = (
            F.when(F.size(n["currencies"]) > 1, "context_currency_ambiguous")
            .when(F.size(n["units"]) > 1, "context_unit_ambiguous")
            .when(own_c.isNotNull() & c.isNotNull() & (own_c != c), "context_currency_conflict")
            .when(own_u.isNotNull() & u.isNotNull() & (own_u != u), "context_unit_conflict")
        )
        return F.struct(
            n["chunk_id"].alias("chunk_id"), n["page"].alias("page"), ((F.size(n["currencies"]) > 0) | (F.size(n["units"]) > 0)).alias("says"),
            issue.alias("issue"), F.coalesce(own_c, c).alias("currency"), F.coalesce(own_u, u).alias("unit"),
        )

    none = F.expr("cast(array() as array<struct<chunk_id:string,page:int,says:boolean,issue:string,currency:string,unit:string>>)")
    judged_all = F.when(settled, none).otherwise(F.transform("neighbours", judged))
    solved = F.filter("judged", lambda n: n["issue"].isNull() & n["currency"].isNotNull() & n["unit"].isNotNull())
    pairs = F.array_distinct(F.transform(solved, lambda n: F.struct(n["currency"], n["unit"])))
    one = F.size(pairs) == 1
    answer = F.element_at(solved, 1)
    return {
        "judged": judged_all,
        "currency": F.when(own_c.isNull() & one, answer["currency"]).otherwise(own_c),
        "unit": F.when(own_u.isNull() & one, answer["unit"]).otherwise(own_u),
        "currency_source": F.when(own_c.isNotNull(), F.col("chunk_id")).when(one, answer["chunk_id"]),
        "unit_source": F.when(own_u.isNotNull(), F.col("chunk_id")).when(one, answer["chunk_id"]),
        "scale_issues": F.array_distinct(
            F.concat(
                _named([("target_currency_ambiguous", several_c), ("target_unit_ambiguous", several_u)]),
                F.filter(F.transform("judged", lambda n: n["issue"]), lambda x: x.isNotNull()),
                _named([("context_currency_unit_conflict", F.size(pairs) > 1)]),
            )
        ),
        "reviewed": F.filter("judged", lambda n: n["says"]),
    }


def candidates(evidence: DataFrame, pages: DataFrame, metric: str) -> DataFrame:
    """A row for each of the first five evidences of a document: what its page says of the metric, status and issues.

    evidence is what `search` gives, pages what `prepare_pages` gives. Evidence whose page is unknown, or which disagrees
    with it on document or page, needs review. A page without the label is `not_found`.
    """
    few = evidence.where(F.col("rank") <= CANDIDATES).withColumnRenamed("text", "evidence_text")
    page = pages.select(F.col("chunk_id").alias("_chunk"), F.col("document_id").alias("_doc"), F.col("page").alias("_page"), "lines", "currencies", "units", "neighbours")
    joined = few.join(page, F.col("chunk_id") == F.col("_chunk"), "left")
    missing = F.col("_chunk").isNull()
    foreign = ~missing & ~(F.col("document_id").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")))
    sound = ~missing & ~foreign
    found = joined.withColumn("label", F.when(sound, label_place(F.col("lines"), LABELS[metric])))
    has_label = F.col("label").isNotNull()
    with_cells = (
        found.withColumn("cells", F.when(has_label, cells_below(F.col("lines"), F.col("label.line"))))
        .withColumn("head", header(F.when(has_label, F.slice("lines", 1, F.col("label.line") - 1))))
    )
    for name, column in _resolved_scale().items():
        with_cells = with_cells.withColumn(name, column)
    answers = lambda h: (F.size(h["periods"]) > 0) | (F.size(h["issues"]) > 0)
    own = answers(F.col("head"))
    elsewhere = F.element_at(F.filter("neighbours", lambda n: answers(n["page_header"])), 1)
    with_periods = (
        with_cells.withColumn("_else", F.when(F.size(F.filter("neighbours", lambda n: answers(n["page_header"]))) > 0, elsewhere))
        .withColumn("period_source", F.when(own, F.col("chunk_id")).otherwise(F.col("_else.chunk_id")))
        .withColumn("periods", F.when(own, F.col("head.periods")).otherwise(F.coalesce("_else.page_header.periods", F.col("head.periods"))))
        .withColumn("period_issues", F.when(own, F.col("head.issues")).otherwise(F.coalesce("_else.page_header.issues", F.col("head.issues"))))
        .withColumn("chosen", F.when(has_label, latest_complete(F.col("periods"), F.col("cells"))))
    )
    months = F.col("chosen.months")
    row_issues = F.concat(
        "scale_issues",
        _named([("currency_missing_or_ambiguous", F.col("currency").isNull()), ("unit_missing_or_ambiguous", F.col("unit").isNull())]),
        "period_issues",
        _named(
            [
                ("target_row_has_no_values", F.size("cells") == 0),
                ("period_value_column_count_mismatch", F.size("periods") != F.size("cells")),
                ("period_header_missing_or_ambiguous", F.size("periods") == 0),
                ("latest_complete_value_not_determinable", F.col("chosen.value").isNull()),
                ("operating_cash_flow_period_months_missing", F.lit(metric == FLOW) & (months.isNull() | ~months.isin(*PERIOD_MONTHS))),
            ]
        ),
    )
    issues = (
        F.when(missing, F.array(F.lit("source_chunk_not_available")))
        .when(foreign, F.array(F.lit("evidence_chunk_identity_mismatch")))
        .when(~has_label, F.array(F.lit("supported_target_label_not_found")))
        .otherwise(F.array_distinct(row_issues))
    )
    intent = F.col("metadata.query_intent")
    priority = F.when(intent == EXPECTED_INTENT[metric], 0).when(intent.isNull() | (intent == ""), 1).otherwise(2)
    bare_status = F.when(sound & ~has_label, "not_found").when(F.size("issues") == 0, "extracted").otherwise("needs_review")
    strength = sum(
        (F.size(F.col(f"metadata.{c}")) > 0).cast("int") for c in ("audited_context", "primary_statement_context", "ending_cash_context", "cash_flow_companions")
    ) + F.col("metadata.table_context").cast("int")
    own_page = F.when(has_label, F.struct(F.col("chunk_id"), F.col("page")))
    source_pages = lambda source: F.filter("neighbours", lambda n: n["chunk_id"] == source)
    used = F.array_distinct(
        F.filter(
            F.concat(
                F.array(own_page),
                *[F.transform(F.coalesce(source_pages(F.col(s)), F.array().cast(pages.schema["neighbours"].dataType)), lambda n: F.struct(n["chunk_id"].alias("chunk_id"), n["page"].alias("page"))) for s in ("currency_source", "unit_source", "period_source")],
                F.transform(F.coalesce("reviewed", F.expr("cast(array() as array<struct<chunk_id:string,page:int,says:boolean,issue:string,currency:string,unit:string>>)")), lambda n: F.struct(n["chunk_id"].alias("chunk_id"), n["page"].alias("page"))),
            ),
            lambda x: x.isNotNull(),
        )
    )
    return (
        with_periods.withColumn("issues", issues)
        .withColumn("status", bare_status)
        .withColumn("intent_priority", priority)
        .withColumn("issues", F.when((F.col("status") != "not_found") & (priority == 2), F.array_append("issues", F.lit("unexpected_query_intent"))).otherwise(F.col("issues")))
        .withColumn("status", F.when((F.col("status") == "extracted") & (priority == 2), "needs_review").otherwise(F.col("status")))
        .withColumn("_used", used)
        .select(
            F.lit(metric).alias("metric_name"), "document_id", "evidence_id", "chunk_id", "page", "rank", "relevance_score", "intent_priority",
            strength.alias("context_strength"), F.coalesce("label.label", F.lit("")).alias("raw_label"), F.coalesce("chosen.raw", F.lit("")).alias("raw_value"),
            F.col("chosen.value").alias("normalized_value"), F.when(has_label, F.col("currency")).alias("currency"), F.when(has_label, F.col("unit")).alias("unit"),
            F.col("chosen.end").alias("period_end"), (F.when(F.lit(metric == FLOW), months)).alias("period_months"), "status", "issues",
            F.transform("_used", lambda u: u["chunk_id"]).alias("context_chunk_ids"), F.array_sort(F.array_distinct(F.transform("_used", lambda u: u["page"]))).alias("context_pages"),
            F.when(F.size("_used") > 1, "page_text_with_adjacent_context").otherwise("page_text_rule").alias("extraction_method"),
        )
    )


CONFLICTS = {
    "normalized_value": "conflicting_values_for_same_period",
    "currency": "conflicting_currency_for_same_period",
    "unit": "conflicting_unit_for_same_period",
    "period_months": "conflicting_period_length_for_same_date",
}


def conflicts(df: DataFrame, partition: list[str], order: list, facts: dict[str, str], comparable: Column | None = None) -> DataFrame:
    """df with place (1 is the chosen row) and conflicts: the codes of facts in which a comparable row disagrees with it.

    comparable is over the row and `_chosen`, the chosen row's struct; two nulls or one never disagree.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = df.withColumn("place", F.row_number().over(w)).withColumn("_chosen", F.first(F.struct(*df.columns)).over(whole))
    same = F.lit(True) if comparable is None else comparable
    # a flag for each code, so that a row carries no more than the codes however many rows its partition has
    every = Window.partitionBy(*partition)
    differs = {code: (F.col("place") > 1) & same & (F.col(f) != F.col(f"_chosen.{f}")) for f, code in facts.items()}
    return ranked.withColumn("conflicts", F.array_sort(_named((code, F.max(F.coalesce(differs[code], F.lit(False))).over(every)) for code in sorted(facts.values()))))


def select(found: DataFrame, documents: DataFrame, metric: str) -> DataFrame:
    """One row for each document: the best candidate, checked against the others; `not_found` where there is none."""
    status_rank = F.when(F.col("status") == "extracted", 0).otherwise(1)
    order = ["intent_priority", F.desc_nulls_last("period_end"), status_rank, F.desc("context_strength"), F.desc("relevance_score"), "rank", F.coalesce("page", F.lit(0)), F.coalesce("evidence_id", F.lit(""))]
    comparable = (F.col("intent_priority") == F.col("_chosen.intent_priority")) & F.col("period_end").eqNullSafe(F.col("_chosen.period_end"))
    usable = found.where("status <> 'not_found'")
    ranked = conflicts(usable, ["document_id"], order, CONFLICTS, comparable)
    every = Window.partitionBy("document_id")
    older = (F.col("place") > 1) & (F.col("intent_priority") == F.col("_chosen.intent_priority")) & (F.col("status") == "extracted") & (F.col("period_end") < F.col("_chosen.period_end"))
    judged = (
        ranked.withColumn("older", F.max(F.coalesce(older, F.lit(False))).over(every))
        .withColumn("evaluated_candidate_count", F.count(F.lit(1)).over(every))
        .where("place = 1")
        .withColumn("status", F.when(F.size("conflicts") > 0, "needs_review").otherwise(F.col("status")))
        .withColumn("_blocked", (F.col("status") == "needs_review") & F.col("older"))
        .withColumn("selection_reason", F.when(F.col("_blocked"), "latest_period_candidate_requires_review").when(F.col("period_end").isNotNull(), "latest_supported_period").otherwise("best_supported_candidate_without_period"))
        .withColumn("issues", F.array_distinct(F.concat("issues", "conflicts", _named([("newer_period_candidate_unresolved", F.col("_blocked"))]))))
        .drop("place", "_chosen", "conflicts", "older", "_blocked", "rank", "relevance_score", "context_strength", "intent_priority")
    )
    nothing = F.array(F.lit("top_5_evidence_contains_no_supported_target_row"))
    absent = F.col("status").isNull()
    return (
        documents.select("document_id").distinct()
        .withColumn("_m", F.lit(metric))
        .join(judged, "document_id", "left")
        .withColumn("issues", F.when(absent, nothing).otherwise(F.col("issues")))
        .withColumn("status", F.coalesce("status", F.lit("not_found")))
        .withColumn("metric_name", F.col("_m"))
        .drop("_m")
    )
