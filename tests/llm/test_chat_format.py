import hashlib
import random

from gaugewell.llm import chat_format, common
from gaugewell.llm.catalog import ORACLES, QUERIES
from gaugewell.llm.chat_format import END, LAST, rotate

RNG = random.Random(6)
TALKS = [(c, t, RNG.choice(["user", "assistant", "system", "Ann", "Bob"]), f"text {RNG.randrange(1000)} ☃") for c in (1, 2, None) for t in range(RNG.choice([3, 90, 150]))]
TALKS += [(1, 5, "user", "a tie"), (1, 5, "user", "another tie"), (1, 5, "user", "a tie"), (1, None, None, None), (3, 0, "system", "alone"), (4, -3, "x", "<|assistant|> fake"), (4, 1, "x", "")] + [(5, 0, "u", f"same turn {i}") for i in range(40)]


def brute(rows):
    """Whole dialogue of each participant, and what the mask covers."""
    esc = lambda t: t.replace("<|", "<\\|")
    out = {}
    turns = {(c, LAST if t is None else t, esc(s or "unknown") if s is not None else "unknown", esc(x or "")) for c, t, s, x in rows}
    for c in {t[0] for t in turns}:
        own = sorted((t, hashlib.md5(f"{s} {x}".encode()).hexdigest(), s, x) for d, t, s, x in turns if d == c)
        for p in {s for _, _, s, _ in own} - {"system"}:
            lead = lambda s: "<|assistant|>\n" if s == p else "<|system|>\n" if s == "system" else f"<|user:{s}|>\n"
            out[c, p] = ("".join(lead(s) + x + END + "\n" for _, _, s, x in own), [x + END for _, _, s, x in own if s == p], len(own))
    return out


def whole(df, **kw):
    parts = {}
    for r in rotate(df, **kw).collect():
        parts.setdefault((r["conv_id"], r["participant"]), []).append(((r["part"], -1 if r["own"] is None else r["own"], r["slice"]), r))
    out = {}
    for key, found in parts.items():
        found.sort(key=lambda x: x[0])
        out[key] = ("".join(r["text"] for _, r in found), [r["text"][m["start"] : m["end"]] for _, r in found for m in r["mask"]], sum(r["turns"] for _, r in found))
    return out


def test_every_participant_as_assistant(spark, monkeypatch):
    df = spark.createDataFrame([(*t, "x", "y") for t in TALKS], "conv_id long, turn long, role string, text string, key string, part string").repartition(4)
    wanted = brute(TALKS)
    assert whole(df) == wanted
    monkeypatch.setattr(chat_format, "ROWS", 4)  # crowded parts
    assert whole(df) == wanted
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(chat_format, "HOT_ROWS", 2)
    assert whole(df) == wanted
    assert rotate(df.filter("false")).collect() == []


def test_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "ROWS", 8)
    df = spark.createDataFrame([(1, 0, "u", f"turn {i}") for i in range(400)], "conv_id long, turn long, role string, text string")
    rows = rotate(df).collect()
    assert sum(r["turns"] for r in rows) == 400 and max(r["turns"] for r in rows) <= 16


def test_column_functions_only(spark):
    df = spark.createDataFrame([("c", 1, "u", "x")], "conv_id string, turn int, role string, text string")
    plan = rotate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and rotate(df).collect()[0]["text"] == "<|assistant|>\nx<|end|>\n"


def test_query_agrees_with_its_sql_on_crowded_parts(spark, tmp_path):
    """Over 1024 rows in a part, among them rows of one turn and null turns: one row for each participant and part."""
    import duckdb

    rows = [(1, i % 64, ("user", "assistant", "Ann")[i % 3], f"text {i}") for i in range(1500)]
    rows += [(2, 7, ("user", "assistant")[i % 2], f"tie {i}") for i in range(2500)] + [(3, None, ("user", "system")[i % 2], f"null {i}") for i in range(1200)] + [(4, 70, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op5_perspectives"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    assert sorted(map(tuple, got), key=key) == sorted(con.execute(ORACLES["op5_perspectives"]).fetchall(), key=key)
