"""The registered queries: those with SQL against it, the others against plain versions, on the smallest tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from quaestor.llm import registry
from quaestor.llm.encoder import default_path

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "conversations")


def _norm(frame):
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
    return sorted(str([cell(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, wanted = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert _norm(found) == _norm(wanted)


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    found = {r.conv_id: r for r in registry.QUERIES["op2_chat_formatting"](spark, SF).collect()}
    assert set(found) == {r[0] for r in rows}
    for c, r in found.items():
        turns = sorted((t, role or "", text or "") for i, t, role, text in rows if i == c)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars >= sum(len(a) + len(b) for _, a, b in turns)


def test_token_query(spark):
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(default_path()), 0
    found = {r.doc_id: r for r in registry.QUERIES["op3_token_files"](spark, SF).collect()}
    for i, text in sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
