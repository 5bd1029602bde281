"""Token counts: whole documents are encoded once, and token spans are joined to sections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.encoder import default_path, encoder
from quaestor.llm.packs import arrow_limits, batch

RULES = ("first", "last", "most")
COUNT_SCHEMA = "doc_id long, section int, begin long, end long, n_tokens long, n_crossing long"
BLOCK_BYTES = 2 << 20


def char_spans(data: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that cover data with so many bytes each; one that holds part of a character spans it."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    stop = np.cumsum(token_bytes)
    start = stop - token_bytes
    return lead[np.minimum(start + 1, len(data))] - 1, lead[stop]


def attribute(begin: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; sections are the spans between ``edges``, without gap.

    A token goes to the section of its first or last character, or to the one that holds most of its characters (the
    first such on ties). It is crossing in the section that it goes to if it reaches beyond it.
    """
    n = len(edges) - 1
    first = np.searchsorted(edges, begin, side="right") - 1
    last = np.searchsorted(edges, np.maximum(end - 1, begin), side="right") - 1
    goes = first if rule == "first" else last.copy()
    if rule == "most":
        for i in np.flatnonzero(first != last):  # crossing tokens only
            held = [min(end[i], edges[s + 1]) - max(begin[i], edges[s]) for s in range(first[i], last[i] + 1)]
            goes[i] = first[i] + int(np.argmax(held))
    crossing = first != last
    return np.bincount(goes, minlength=n)[:n], np.bincount(goes[crossing], minlength=n)[:n]


def _line_edges(text: str) -> list[int]:
    at, out = -1, [0]
    while (at := text.find("\n", at + 1)) >= 0:
        out.append(at + 1)
    return out if out[-1] == len(text) and len(out) > 1 else [*out, len(text)]


def token_counts(docs: DataFrame, rule: str = "first", tokenizer: str | None = None, edges: str | None = None) -> DataFrame:
    """doc_id, section, begin, end, n_tokens, n_crossing of each section of each row of docs (doc_id, text).

    Sections are lines with their line feed, or the spans between the character places in the array column ``edges``
    (ascending; 0 and the text's length are added). begin and end are in characters. Each token of the
    whole text counts in exactly one section, chosen by ``rule`` (see attribute), so that a document's
    sections add up to its tokens.

    Null or empty text: one empty section. Repeated rows and null doc_id pass row by row. Other columns aren't read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_path()

    def run(batches):
        from quaestor.llm.chat import _byte_table

        own = encoder(path, added=True)
        sizes = np.array([len(x) for x in _byte_table(own)])
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            given = b.column(2).to_pylist() if edges else [None] * len(ids)
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                while hi < len(ids) and (hi == lo or size + 4 * len(texts[hi]) < BLOCK_BYTES):
                    size += 4 * len(texts[hi])
                    hi += 1
                raw = [t.encode() for t in texts[lo:hi]]
                if own.by_pieces:
                    tokens, at = own.encode(raw)
                    spans = [char_spans(np.frombuffer(r, np.uint8), sizes[tokens[x:y]]) for r, x, y in zip(raw, at[:-1], at[1:])]
                else:
                    found = own.tokenizer.encode_batch(texts[lo:hi], add_special_tokens=False)
                    spans = [tuple(np.array(e.offsets, np.int64).reshape(-1, 2).T) for e in found]
                rows = []
                for i, text, cut, (begin, end) in zip(ids[lo:hi], texts[lo:hi], given[lo:hi], spans):
                    edge = np.array(_line_edges(text) if cut is None else sorted({0, len(text), *(c for c in cut if 0 < c < len(text))}), np.int64)
                    edge = edge if len(edge) > 1 else np.array([0, 0])
                    n, crossing = attribute(begin, end, edge, rule) if len(begin) else (np.zeros(len(edge) - 1, int),) * 2
                    rows += [(i, s, int(edge[s]), int(edge[s + 1]), int(n[s]), int(crossing[s])) for s in range(len(edge) - 1)]
                yield batch(COUNT_SCHEMA, rows)
                lo = hi

    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text", *([edges] if edges else [])).mapInArrow(run, COUNT_SCHEMA)


def field_token_counts(docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """doc_id, field, begin, end, n_tokens, n_crossing: the tokens of each field of each row, of the fields joined by the separator and encoded as one text.

    A separator (not empty) belongs to the field before it, so that a row's fields add up to the tokens of the joined text. Null fields are empty; an empty last
    field has no character and no row. docs: doc_id and the fields; columns are found as Spark finds them.
    """
    if not separator or len(fields) < 1:
        raise ValueError("a separator and at least one field are needed")
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    lengths = [F.char_length(v) + (len(separator) if i < len(fields) - 1 else 0) for i, v in enumerate(values)]
    edges, total = [], F.lit(0)
    for n in lengths:
        total = total + n
        edges.append(total)
    joined = docs.select("doc_id", F.concat_ws(separator, *values).alias("text"), F.array(*edges).alias("edges"))
    found = token_counts(joined, rule, tokenizer, "edges")
    return found.select("doc_id", F.get(F.array(*map(F.lit, fields)), F.col("section")).alias("field"), "begin", "end", "n_tokens", "n_crossing")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
