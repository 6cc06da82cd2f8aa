"""Personal data, and the words of documents that give it away.

E-mail, IP, card and phone numbers are the protected entities. A term reveals an entity as far
as knowing the term makes the entity likely: over the corpus, the pointwise mutual information
of term and entity, as a share of the entity's own information (after Sanchez and Batet's
information-theoretic sanitisation). What meets by chance reveals nothing, so a pair counts
only if documents with both are too many for independence, by a log-likelihood ratio test that
allows for the number of pairs looked at. A term that reveals more than the threshold is
generalised, one that gives the entity away all but fully is removed, both wherever the term
stands, also in documents without the entity.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storygraph.session import materialize

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
# A match begins with a whole run of digits, whatever stood before; so no run is read twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
TERM = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}|*#%&$<>-_"

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
PLACE = T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
ARROW_PLACES = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
BROADCAST_TERMS = 200_000
FLUSH = 200_000
LEAST_DOCS = 3  # documents with both that a pair needs
DOUBT = 0.05  # chance that any pair of the corpus passes the test without cause


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(m: re.Match) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Where an address stands: from each @ to the left over its class, to the right by the pattern. Linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        else:
            # No address reaches over this sign.
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the entities of a text, per kind leftmost and not overlapping, in the order of kinds, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b, text[a:b]) for a, b in emails(text)]
    numbers = [m for m in CARD.finditer(text)]
    if "." in text:
        out += [("ip", *m.span(), m[0]) for m in IP.finditer(text) if _octets(m)]
    for m in numbers:
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span(), m[0]))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span(), m[0]))
    return out


def entity_key(kind: str, value: str) -> str:
    """One name per protected entity, however it is spelled."""
    return f"{kind} {value.lower() if kind in ('email', 'ip') else NOT_DIGIT.sub('', value)}"


def terms_of(text: str, spans: list[tuple[str, int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words of a text without those of an entity: lower case, without punctuation around."""
    taken = sorted((s, e) for _, s, e, _ in spans)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in TERM.finditer(text):
        before = bisect_left(starts, m.end()) if taken else 0
        if before and reach[before - 1] > m.start():
            continue
        word = m[0].strip(EDGES)
        if word:
            at = m.start() + m[0].index(word)
            yield word.lower(), at, at + len(word)


def distinct_terms(text: str, spans: list[tuple[str, int, int, str]]) -> set[str]:
    if spans:
        return {t for t, _, _ in terms_of(text, spans)}
    # Lower-cased as a whole; only the white space of ASCII parts words.
    words = set(text.lower().encode("utf-8", "surrogatepass").split())
    return {w.decode("utf-8", "surrogatepass").strip(EDGES) for w in words} - {""}


def _with_entities(docs: DataFrame, text_col: str) -> DataFrame:
    """(entities, terms) of the rows that hold an entity, each once per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entities, terms = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text) if text else []
                if spans:
                    entities.append(sorted({entity_key(k, v) for k, _, _, v in spans}))
                    terms.append(list(distinct_terms(text, spans)))
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))], ["entities", "terms"])

    return docs.select(F.col(text_col)).mapInArrow(scan, "entities array<string>, terms array<string>")


def _rows_with(docs: DataFrame, text_col: str, terms: DataFrame, n: int) -> DataFrame:
    """(term, n_term): the rows of ``docs`` that hold each of ``n`` terms. Few are looked up, more are thinned out and joined."""
    few = n <= BROADCAST_TERMS
    shared = docs.sparkSession.sparkContext.broadcast(set(terms.toArrow()["term"].to_pylist()) if few else _bits(terms, n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    here = distinct_terms(text, base_spans(text))
                    seen.update(here & known if few else [t for t in here if _in_bits(known, t)])
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(text_col)).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted if few else counted.join(terms, "term", "left_semi")


def _ratio(a: Column, row: Column, column: Column, n: Column) -> Column:
    """The log-likelihood ratio (G squared) of a two by two table, from one cell, its margins and the total."""

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    cells = ((a, row, column), (row - a, row, n - column), (column - a, n - row, column), (n - row - column + a, n - row, n - column))
    return F.lit(2.0) * reduce(Column.__add__, [cell(seen, r * c / n) for seen, r, c in cells])


def disclosures(docs: DataFrame, text_col: str = "text", min_docs: int = LEAST_DOCS, least: float = 0.0) -> DataFrame:
    """(entity, term, disclosure) of terms that reveal an entity, from ``least`` on.

    disclosure = log(n(e,t) N / (n(e) n(t))) / log(N / n(e)), all counted in whole rows: 1 if the
    term occurs nowhere but beside the entity. A pair needs ``min_docs`` rows with both, and
    a log-likelihood ratio against independence beyond 2 log(pairs / DOUBT): any rare word
    meets the entities of its one row, so a single meeting is no evidence. Only rows with an
    entity are asked for pairs, and only terms of pairs seen often enough are counted in the
    whole corpus.
    """
    held, _ = materialize(_with_entities(docs, text_col))
    n_rows = docs.count()
    n_entity = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    often, _ = materialize(n_entity.filter(F.col("n_entity") >= min_docs))
    each = held.select(F.explode("entities").alias("entity"), "terms").join(often, "entity")
    pairs = each.select("entity", "n_entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_entity").alias("n_entity"))
    # All pairs looked at count for the test, the others can be left out.
    told, seen = materialize(pairs.select("*", F.lit(1).alias("one")), pairs=F.sum("one"))
    told = told.filter(F.col("n_both") >= min_docs).drop("one")
    terms, wanted = materialize(told.select("term").distinct())
    if not wanted["rows"]:
        return told.select("entity", "term", F.lit(0.0).alias("disclosure")).limit(0)
    told = told.join(_rows_with(docs, text_col, terms, wanted["rows"]), "term")
    n = F.lit(float(n_rows))
    real = _ratio(F.col("n_both").cast("double"), F.col("n_entity").cast("double"), F.col("n_term").cast("double"), n) > 2 * math.log((seen["pairs"] or 1) / DOUBT)
    more = F.col("n_both") * n > F.col("n_entity") * F.col("n_term")
    info = F.log(n / F.col("n_entity"))
    mutual = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    share = F.when(info > 0, mutual / info).otherwise(0.0)
    return told.filter(real & more).select("entity", "term", share.alias("disclosure")).filter(F.col("disclosure") >= least)


def sanitisation_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = LEAST_DOCS,
    generalise_at: float = 0.6,
    remove_at: float = 0.9,
) -> DataFrame:
    """(id, spans, terms) for every row of ``docs``.

    ``spans`` are the entities (kind, start, end, value); ``terms`` are further spans of kind
    ``generalise`` or ``remove``, in the order of kind and start, for all words of the corpus that disclose at least that share
    of any entity. A null text counts as empty, repeated rows each have their own spans, other
    columns play no part. Telling terms are broadcast while they are few, else joined.
    """
    kind = F.when(F.max("disclosure") >= remove_at, "remove").otherwise("generalise")
    told, seen = materialize(disclosures(docs, text_col, min_docs, generalise_at).groupBy("term").agg(kind.alias("kind")))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    sc = docs.sparkSession.sparkContext
    few = seen["rows"] <= BROADCAST_TERMS
    if few:
        table = told.toArrow()
        marks = sc.broadcast(dict(zip(table["term"].to_pylist(), table["kind"].to_pylist(), strict=True)))
    else:
        marks = sc.broadcast(_bits(told, seen["rows"]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marks.value
        for batch in batches:
            spans, terms = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else []
                spans.append([dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in found])
                if few and (not known or known.keys().isdisjoint(distinct_terms(text or "", found))):
                    terms.append([])
                    continue
                places = terms_of(text or "", found)
                if few:
                    marked = [(known[t], s, e, t) for t, s, e in places if t in known]
                    terms.append([dict(zip(("kind", "start", "end", "value"), m, strict=True)) for m in sorted(marked)])
                else:
                    terms.append([{"term": t, "start": s, "end": e} for t, s, e in places if _in_bits(known, t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, ARROW_SPANS), pa.array(terms, ARROW_SPANS if few else ARROW_PLACES)], ["id", "spans", "terms"])

    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("terms", T.ArrayType(SPAN if few else PLACE))])
    found = rows.mapInArrow(scan, out)
    if few:
        return found.select(F.col("id").alias(id_col), "spans", "terms")
    found, _ = materialize(found.select(F.monotonically_increasing_id().alias("row"), "id", "spans", "terms"))
    marked = found.select("row", F.explode("terms").alias("t")).select("row", "t.*").join(told, "term")
    per_row = marked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", F.col("term").alias("value")))).alias("t"))
    terms = F.transform(F.coalesce("t", F.array()), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return found.select("row", "id", "spans").join(per_row, "row", "left").select(F.col("id").alias(id_col), "spans", terms.alias("terms"))


def _bits(told: DataFrame, n: int) -> np.ndarray:
    """One bit for the hash of each term, in 64 times as many bits, 32 MB at most: leaves out nearly all other terms before the join."""
    size = 1 << min(28, max(10, (64 * n).bit_length()))
    bits = np.zeros(size // 8, np.uint8)
    at = told.select(F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(size)).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _in_bits(bits: np.ndarray, term: str) -> bool:
    at = zlib.crc32(term.encode("utf-8", "replace")) & (8 * len(bits) - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": ""}


def general_form(word: str) -> str:
    """What a term is generalised to: its shape."""
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitised_text(text: str, spans: list[dict]) -> str:
    """The text with entities and telling terms replaced; of overlapping spans the first, longest one counts."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:
            at = max(at, s["end"])
            continue
        piece = text[s["start"] : s["end"]]
        out += [text[at : s["start"]], general_form(piece) if s["kind"] == "generalise" else LABELS[s["kind"]]]
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts, by the result of ``sanitisation_spans``; ids must be unique.

    Only rows with a span take part in the join; the others pass as they are.
    """
    cut = spans.select(F.col(id_col).alias("_id"), F.concat("spans", "terms").alias("_spans")).filter(F.size("_spans") > 0)
    joined = docs.join(cut, docs[id_col] == F.col("_id"), "left")

    @F.pandas_udf("string")
    def replaced(texts, marks):
        return texts.combine(marks, lambda t, s: t if t is None or s is None else sanitised_text(t, list(s)))

    text = F.when(F.col("_spans").isNull(), docs[text_col]).otherwise(replaced(docs[text_col], F.col("_spans")))
    return joined.withColumn(text_col, text).select(*docs.columns)
