"""Explainable evidence search over the pages of documents.

Pages are normalised once (`prepare`) and given what doesn't depend on a query: context phrases and the nearest statement
title on the four pages before. A search then keeps the matching pages, adds up thirteen terms and takes the best k of
each document. A page's neighbourhood is a window over the document's pages, not a join, and the top k is a row number
that Spark cuts off before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.ids import uuid5
from ..functions.forms import normal_forms
from ..functions.text import compact, compacted, looks_like_table, normalise, normalised, phrases_in, snippet

REACH = 4
MARGIN = 450
ENDING_INTENTS = ("cash_flow_ending_cash", "cash_and_cash_equivalents")


def intent_of(query: str) -> tuple[str, tuple[str, ...]]:
    """Intent of a query and the aliases that search beside it; compact forms are compared."""
    form = compacted(query)
    for intent, names, aliases in lexicon.INTENTS:
        if form in {compacted(n) for n in names}:
            return intent, aliases
    return lexicon.GENERIC, ()


def statement_neighborhood(pages: DataFrame, is_title: Column, audited: Column, payload: Sequence[str] = (), document: str = "document_id", page: str = "page", reach: int = REACH) -> DataFrame:
    """pages with neighborhood: struct<not_audited, distance, title_page, payload...> of the best title within reach.

    Best is an audited title, then the nearest, then what the payload orders. Null if there is none.
    """
    title = F.struct((~audited).alias("not_audited"), F.col(page).alias("title_page"), *payload)
    before = Window.partitionBy(document).orderBy(page).rangeBetween(-reach, 0)
    seen = F.collect_list(F.when(is_title, title)).over(before)
    measured = F.transform(
        seen,
        lambda t: F.struct(t["not_audited"].alias("not_audited"), (F.col(page) - t["title_page"]).alias("distance"), t["title_page"].alias("title_page"), *[t[p].alias(p) for p in payload]),
    )
    return pages.withColumn("neighborhood", F.array_min(measured))


def prepare(chunks: DataFrame) -> DataFrame:
    """chunks with normal, compact and the contexts of every search. Worth keeping when many queries follow."""
    normal = F.col("normal")
    with_text = chunks.withColumn("normal", normalise(F.col("text"))).withColumn("compact", compact(normal))
    with_phrases = with_text.withColumns(
        {
            "titles": phrases_in(normal, lexicon.STATEMENT_TITLES),
            "audited_here": phrases_in(normal, lexicon.AUDITED),
            "financial_context": phrases_in(normal, lexicon.FINANCIAL),
            "negative_context": phrases_in(normal, lexicon.NEGATIVE),
            "summary_context": phrases_in(normal, lexicon.SUMMARY),
            "note_context": phrases_in(normal, lexicon.NOTES),
            "ending_cash_context": phrases_in(normal, lexicon.ENDING_CASH),
            "reconciliation_context": phrases_in(normal, lexicon.RECONCILIATION),
            "companions": F.filter(
                F.array(
                    *[
                        F.when(F.size(phrases_in(normal, phrases)) > 0, F.lit(name))
                        for name, phrases in (
                            ("beginning_cash", lexicon.BEGINNING_CASH),
                            ("net_change", lexicon.CASH_CHANGE),
                            ("exchange_effect", lexicon.EXCHANGE_EFFECT),
                            ("ending_cash", lexicon.ENDING_CASH),
                        )
                    ]
                ),
                lambda x: x.isNotNull(),
            ),
            "table_context": looks_like_table(F.col("text"), normal),
        }
    )
    return statement_neighborhood(with_phrases, F.size("titles") > 0, F.size("audited_here") > 0, ("titles", "audited_here"))


FOUND = "array<struct<query_id:string,keywords:array<string>,aliases:int,exact:boolean,start:int,end:int>>"
QUERIES = "query_id string, form string, intent string, broad boolean, terms array<string>"

#: Terms up to which pages without any of them are left out by built-in functions before the automaton sees them.
FEW_TERMS = 64


def asked_of(queries: Mapping[str, str]) -> list[tuple[str, str, str, bool, list[str]]]:
    """(query_id, form, intent, broad, terms) of the queries that aren't blank; a query's first term is its own form."""
    broad, out = {compacted(b) for b in lexicon.BROAD}, []
    for query_id, text in queries.items():
        if form := normalised(text or ""):
            intent, aliases = intent_of(form)
            out.append((query_id, form, intent, compacted(form) in broad, list(dict.fromkeys([form, *(normalised(a) for a in aliases)]))))
    return out


class Terms:
    """All terms of all queries in two automata: one for spaced forms, one for forms without spaces.

    Without across_spaces there is only the first.
    """

    def __init__(self, asked: Sequence[tuple[str, list[str]]], across_spaces: bool = True):
        import ahocorasick

        self.ids = [query_id for query_id, _ in asked]
        places: tuple[dict, dict] = ({}, {})
        for q, (_, terms) in enumerate(asked):
            for i, term in enumerate(terms):
                for needle, by in zip((term, term.replace(" ", "")), places):
                    by.setdefault(needle, []).append((q, term, i == 0))
                    if i and term == terms[0]:
                        by[needle].append((q, term, False))
        self.automata = []
        for by in places if across_spaces else places[:1]:
            automaton = ahocorasick.Automaton()
            for needle, uses in by.items():
                automaton.add_word(needle, (len(needle), uses))
            automaton.make_automaton()
            self.automata.append(automaton)

    def meets(self, form: str) -> bool:
        return any(next(a.iter(hay), None) for a, hay in zip(self.automata, (form, form.replace(" ", ""))))

    def matches(self, form: str, places: Sequence[int]) -> list[dict]:
        """What of each query's terms a text holds, and the place of the best match.

        Every occurrence counts, overlapping ones too. Best is the query itself, then the longest stretch of the text, then
        the first.
        """
        tight = [i for i, c in enumerate(form) if c != " "]
        best: dict[int, tuple] = {}
        keywords: dict[int, set[str]] = {}
        named: dict[int, set[str]] = {}
        for automaton, hay, at in zip(self.automata, (form, "".join(form[i] for i in tight)), (places, [places[i] for i in tight])):
            for last, (size, uses) in automaton.iter(hay):
                start, end = int(at[last - size + 1]), int(at[last]) + 1
                for q, term, exact in uses:
                    rank = (exact, end - start, -start)
                    best[q] = max(best.get(q, rank), rank)
                    keywords.setdefault(q, set()).add(term)
                    if not exact:
                        named.setdefault(q, set()).add(term)
        return [
            {"query_id": self.ids[q], "keywords": sorted(keywords[q]), "aliases": len(named.get(q, ())), "exact": exact, "start": -start, "end": size - start}
            for q, (exact, size, start) in sorted(best.items())
        ]


def search(prepared: DataFrame, query: str, limit: int = 3, query_id: str | None = None, across_spaces: bool = True) -> DataFrame:
    """The best `limit` pages of each document as evidence rows; a blank query or no limit gives none."""
    return search_many(prepared, {query if query_id is None else query_id: query}, limit, across_spaces)


def search_many(prepared: DataFrame, queries: Mapping[str, str], limit: int = 3, across_spaces: bool = True) -> DataFrame:
    """The best `limit` pages of each document for each query (by its id), in one pass over the pages however many there are.

    A term is also found where the text parts it by spaces, which Chinese pages do at random. In other scripts that takes
    the ends of words for others ("Eau pa che" has apache): without across_spaces a term must be written as it is.
    The queries' own facts are a table of one row each; it is broadcast, and as large as the mapping that was passed in.
    """
    spark, asked = prepared.sparkSession, asked_of(queries)
    terms_of = [(query_id, terms) for query_id, _, _, _, terms in asked]

    def match_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        terms = Terms(terms_of, across_spaces)
        for texts, normals in batches:
            hits = [i for i, form in enumerate(normals) if terms.meets(form)]
            out: list[list[dict]] = [[]] * len(texts)
            for i, (form, places) in zip(hits, normal_forms([texts.iloc[i] for i in hits])):
                out[i] = terms.matches(form, places)
            yield pd.Series(out)

    distinct = list(dict.fromkeys(term for _, terms in terms_of for term in terms))
    some = prepared.where(F.lit(bool(asked) and limit > 0))
    if len(distinct) <= FEW_TERMS:
        there = F.lit(False)
        for term in distinct:
            there = there | F.contains("normal", F.lit(term))
            if across_spaces:
                there = there | F.contains("compact", F.lit(term.replace(" ", "")))
        some = some.where(there)
    facts = spark.createDataFrame(asked, QUERIES).drop("terms").withColumnRenamed("query_id", "_query_id")
    some = some.withColumn("_found", F.pandas_udf(match_batches, FOUND)("text", "normal")).withColumn("match", F.explode("_found")).drop("_found")
    some = some.join(F.broadcast(facts), F.col("match.query_id") == F.col("_query_id"))
    return _scored(some, limit, [c for c in ("section",) if c in prepared.columns])


def _scored(some: DataFrame, limit: int, kept: list[str]) -> DataFrame:
    """Evidence rows of matched pages (match, form, intent and broad beside what `prepare` gives)."""
    m, near, form, intent, broad = (F.col(c) for c in ("match", "neighborhood", "form", "intent", "broad"))
    ending = intent.isin(*ENDING_INTENTS)
    primary = (
        F.when(ending, F.concat("reconciliation_context", "ending_cash_context"))
        .when(intent == "operating_cash_flow", F.col("audited_here"))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )
    has = lambda c: F.size(c) > 0
    audited = F.coalesce(F.col("neighborhood.audited_here"), F.expr("cast(array() as array<string>)"))
    on = lambda cond, points: F.when(cond, points if isinstance(points, Column) else F.lit(float(points))).otherwise(F.lit(0.0))
    terms = {
        "exact_query": on(m["exact"], F.when(broad, 0.08).otherwise(0.24)),
        "full_alias": on(m["aliases"] > 0, 0.18),
        "additional_aliases": F.least(F.lit(0.08), F.greatest(F.lit(0), m["aliases"] - 1) * F.lit(0.04)),
        "financial_context": on(has("financial_context"), 0.08),
        "statement_neighborhood": on(near.isNotNull(), F.greatest(F.lit(0.20), F.lit(0.38) - F.lit(0.04) * near["distance"])),
        "audited_context": on(has(audited), 0.12),
        "primary_statement_context": on(has(primary), 0.18),
        "ending_cash_context": on(has("ending_cash_context") & ending, 0.24),
        "cash_flow_companions": on(ending, F.least(F.lit(0.18), F.size("companions") * F.lit(0.06))),
        "table_context": on(F.col("table_context"), 0.08),
        "summary_context": on(has("summary_context"), -0.28),
        "note_context": on(has("note_context") & near.isNull(), -0.16),
        "negative_context": on(has("negative_context"), -0.45),
    }
    total = F.lit(0.0)
    for name in terms:
        total = total + F.col(f"score_breakdown.{name}")
    first = F.greatest(F.lit(0), m["start"] - MARGIN)
    last = F.least(F.length("text"), m["end"] + MARGIN)
    name = F.concat_ws("|", "document_id", "chunk_id", form, first, last)
    scored = (
        some.withColumn("score_breakdown", F.struct(*[v.alias(k) for k, v in terms.items()]))
        .withColumn("relevance_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
        .where("relevance_score > 0")
        .withColumn("evidence_id", uuid5(name))
    )
    best = Window.partitionBy("_query_id", "document_id").orderBy(F.desc("relevance_score"), "page", "chunk_id", "evidence_id")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= limit)
        .select(
            F.col("_query_id").alias("query_id"),
            "document_id",
            "rank",
            "evidence_id",
            "chunk_id",
            "page",
            *kept,
            snippet(F.col("text"), m["start"], m["end"], MARGIN).alias("text"),
            F.lit("prospectus").alias("source_type"),
            "relevance_score",
            F.struct(
                F.lit("keyword").alias("retriever"), form.alias("normalized_query"), intent.alias("query_intent"), broad.alias("broad_query"),
                m["keywords"].alias("matched_keywords"), F.when(m["exact"], "exact_query").otherwise("full_alias").alias("match_type"),
                first.alias("snippet_start"), last.alias("snippet_end"), F.length("text").alias("source_text_length"), "score_breakdown", "financial_context",
                primary.alias("primary_statement_context"), near["distance"].alias("statement_distance"), near["titles"].alias("statement_titles"),
                audited.alias("audited_context"), "ending_cash_context", F.col("companions").alias("cash_flow_companions"), "table_context", "summary_context", "note_context", "negative_context",
            ).alias("metadata"),
        )
    )


def token_search(chunks: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """Stand-in search: pages that share a word with the query in order of page, else the first page; score 1."""
    words = F.array(*[F.lit(w) for w in query.lower().split()]).cast("array<string>")
    shares = F.arrays_overlap(F.split(F.lower("text"), r"(?U)\s+"), words)
    order = Window.partitionBy("document_id").orderBy(F.desc("_hit"), "page", "chunk_id")
    ranked = chunks.withColumn("_hit", shares).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("_hit") & (F.col("rank") <= limit)) | (F.col("rank") == 1)).withColumn("relevance_score", F.lit(1.0)).drop("_hit")
