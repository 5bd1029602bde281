"""Chat formatting: token-level assembly with reserved ids, loss masks by prefix sums, reversible escapes.

As text a turn is ``### role: text</turn>`` and a line feed. As ids it is OPEN, role, CLOSE_ROLE, text, END:
three reserved ids above the vocabulary, and segments that are encoded apart, so that no content can make or change a reserved id.
Inside segments a backslash is doubled, and one is put before each control string; in roles also before a colon.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.encoder import SYMBOLS, default_path, encoder
from quaestor.llm.packs import arrow_limits, batch, squeeze, unsqueeze
from quaestor.llm.storage import written

MARKS = ("### ", ": ", "</turn>\n")  # of the three reserved ids, in order
LOSS_ROLES = ("assistant",)
_CONTROL, _ROLE_CONTROL, _ESCAPED = re.compile(r"###|</turn>"), re.compile(r"###|</turn>|:"), re.compile(r"\\(.)", re.S)
FORMATTED_SCHEMA = "conv_id long, turn long, role string, text_sha256 string, n_ids long, ids binary, mask binary"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(r"\\\g<0>", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; control strings count where an even number of backslashes precedes them."""
    turn = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
    out, at = [], 0
    while at < len(formatted):
        m = turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_turns(conversations: DataFrame, tokenizer: str | None = None, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, turn, role, text_sha256, n_ids, ids, mask of each row of conversations (conv_id, turn, role, text).

    ids (uint32) and mask (one byte for each id) are compressed; a conversation's sequence is its rows' in the
    order of turn. The mask covers the ids of a text whose role is in loss_roles, no marks. Null role or text: empty.
    Rows are formatted apart, so a conversation of any length is spread over tasks.
    """
    path = tokenizer or default_path()

    def run(batches):
        own = encoder(path)
        vocabulary = own.tokenizer.get_vocab_size()
        for b in batches:
            convs, turns, roles, texts = (b.column(k).to_pylist() for k in range(4))
            segments = []
            for r, t in zip(roles, texts):
                segments += [escape(r or "", role=True).encode(), escape(t or "").encode()]
            ids, at = own.encode(segments)
            rows = []
            for k, (c, turn, role) in enumerate(zip(convs, turns, roles)):
                parts = [[vocabulary], ids[at[2 * k] : at[2 * k + 1]], [vocabulary + 1], ids[at[2 * k + 1] : at[2 * k + 2]], [vocabulary + 2]]
                edge = np.cumsum([len(p) for p in parts])
                change = np.zeros(edge[-1] + 1, np.int8)
                if role in loss_roles:
                    change[edge[2]] += 1
                    change[edge[3]] -= 1
                mask = np.cumsum(change[:-1], dtype=np.int8)
                rows.append((c, turn, role, hashlib.sha256((texts[k] or "").encode()).hexdigest(), int(edge[-1]), squeeze(np.concatenate(parts).astype(np.uint32)), squeeze(mask)))
            yield batch(FORMATTED_SCHEMA, rows)

    arrow_limits(conversations.sparkSession)
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, FORMATTED_SCHEMA)


def _byte_table(own) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary, whose symbols stand for bytes one by one."""
    symbol = {c: b for b, c in enumerate(SYMBOLS)}
    table = [b""] * own.tokenizer.get_vocab_size()
    for token, i in own.tokenizer.get_vocab().items():
        table[i] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()
    return table


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from ids and masks alone.

    Rows stream by (conv_id, turn); a task holds one turn and the running digests, however long the conversation.
    Rows of one turn follow each other by role and the digest of their text. A null conv_id is a conversation like any other.
    """
    path = tokenizer or default_path()

    def run(batches):
        own = encoder(path)
        table, first = _byte_table(own), own.tokenizer.get_vocab_size()
        text_of = lambda ids: b"".join(map(table.__getitem__, ids.tolist()))
        now, done, state = None, [], None

        def close():
            done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, packed_ids, packed_mask in zip(*(b.column(k).to_pylist() for k in range(3))):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = unsqueeze(packed_ids, np.uint32), unsqueeze(packed_mask, np.int8) > 0
                close_role = int(np.flatnonzero(ids == first + 1)[0])
                if ids[0] != first or ids[-1] != first + 2:
                    raise ValueError("not a formatted turn")
                role, text = text_of(ids[1:close_role]).decode(), text_of(ids[close_role + 1 : -1]).decode()
                loss = unescape(text_of(ids[mask]).decode())
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(role) + len(text) + sum(map(len, MARKS))
            if len(done) > 1000:
                yield batch(READ_SCHEMA, done)
                done.clear()
        if now is not None:
            close()
        yield batch(READ_SCHEMA, done)

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_sha256")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, READ_SCHEMA)


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(written(format_turns(rows.unionByName(probe))))
