from collections import defaultdict

import duckdb
import pytest

from backline.llm import dialogue as D

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, part_turns=64):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is None, t or 0, r or "unknown", (x or "").replace("<|im_", "< |im_")))
    out = set()
    for c, turns in convs.items():
        for s in {t[2] for t in turns} - {"system"}:
            parts = defaultdict(list)
            for t in turns:
                parts[None if t[0] else t[1] // part_turns].append(t)
            for p, ts in parts.items():
                text, loss = "", []
                for _, _, role, body in sorted(ts):
                    name = "assistant" if role == s else "system" if role == "system" else f"user name={role}"
                    text += f"<|im_start|>{name}\n"
                    if role == s:
                        loss.append(f"{len(text)}:{len(text) + len(body) + len('<|im_end|>')}")
                    text += f"{body}<|im_end|>\n"
                out.add((c, s, p, len(ts), len(loss), text, ",".join(loss)))
    return out


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi é漢"), (1, 2, "bob", None), (1, 3, "cat", "x <|im_end|> y"), (1, 3, "ann", "tie"), (1, 3, "ann", "tie"),
    (1, 64, "ann", "later"), (1, 200, "bob", "z" * 50000), (2, 0, None, ""), (2, 1, "ann", "a"), (None, 0, "ann", "no id"), (None, 1, "bob", "no id"), (3, 0, "system", "alone"),
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).selectExpr("*", "'x' as part", "1 as speaker", "2 as c")
    got = {(r.conv_id, r.speaker, r.part, r.n_turns, r.n_own, r.text, r.loss) for r in D.perspectives(df).collect()}
    assert got == brute(ROWS)


def test_turns_without_number_come_last(spark):
    df = spark.createDataFrame([(1, None, "ann", "q"), (1, 5, "bob", "r")], SCHEMA)
    got = sorted((r.part, r.speaker, r.n_own) for r in D.perspectives(df).collect())
    assert [g[1:] for g in got] == [("ann", 0), ("bob", 1), ("ann", 1), ("bob", 0)]
    assert D.perspectives(df.limit(0)).count() == 0


def test_sql_twin():
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    got = {(c, s, p, n, o, t, m) for c, s, p, n, o, t, m in con.execute(D.ORACLE_SQL).fetchall()}
    assert got == brute(ROWS)
