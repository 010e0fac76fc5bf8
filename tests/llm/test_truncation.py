import random

from codeloom.llm import truncation as T

ROW = "id long, cfg int, origin string, intro string, closing string, source string, text string"
BASE = "The nightly job writes a snapshot and compares it with the one of the day before. Nobody owns the file since the team was split. "


def found(spark, rows):
    df = spark.createDataFrame([(i, c, o, a, b, "clash", "clash") for i, c, o, a, b in rows], ROW)
    return {(x["id"], x["field_name"]): x["evidence"] for x in T.find_truncated(df, "id", ["intro", "closing"], ["cfg", "origin"]).collect()}


def test_ends(spark):
    whole = ["A sentence.", "Really?", "He said “done.”", "Sum (of all).", "List:\n- `a`\n- `b`", "Code:\n```\nx = 1\n```", "Text here.\n\nAnd so on...", "Ok.\n\nCheck it first (it is short)", "Fin !", "日本語です。"]
    cut = {
        "It was the": "run", "Half of it...": "run", "Half of i…": "run", "Not done [truncated]": "mark", "Not done. … (more)": "mark", "Bytes went mis\ufffd": "mark", "See `open": "code", "Code:\n```\nx = (": "code", "The end <cut>": "mark",
        "List:\n- `a`\n- `b": "code", "Done.\n\nThe team": "line-short", "Done.\n\nAll of the files are in the": "line", "Done.\n- a file": "line-item-short", "Done.\n[...]  \n": "mark",
    }
    rows = spark.createDataFrame([(t,) for t in [*whole, *cut]], "text string")
    got = {r["text"]: r["end"] for r in T.ends(rows).collect()}
    assert got == dict.fromkeys(whole, "proper") | cut


def _values(seed=1, limit=255):
    """Every value passes a field of 255 characters; a quarter is lost on the way, a quarter ends with a line of its own."""
    r = random.Random(seed)
    rows, cut, own = [], set(), set()
    for i in range(400):
        t = BASE * 6
        if i % 4 == 0:
            t = t[:limit]
        elif i % 4 == 1:
            t = BASE[: r.randrange(40, 120)].rstrip() + ".\n\n" + r.choice(["The team", "Greetings", "File " + str(i)])
            own.add((i, "intro"))
        elif i % 4 == 2:
            t = BASE[: r.randrange(40, 130)].rstrip() + "x."
        else:
            t = t[: r.randrange(30, limit - 5)].rstrip(" .") + "x y"
        if i % 4 in (0, 3):
            cut.add((i, "intro"))
        rows.append((i, 1, "a", t, None))
    return rows, cut, own


def test_spikes_decide(spark):
    rows, cut, own = _values()
    got = found(spark, rows)
    assert set(got) == cut and not set(got) & own
    assert {v for (i, _), v in got.items() if i % 4 == 0} == {"spike"}
    # without the values at the limit there is no spike, and nothing tells a cut from a writer's habit
    assert found(spark, [x for x in rows if x[0] % 4]) == {}


def test_spike_must_be_at_the_maximum(spark):
    rows, cut, _ = _values()
    longer = [(1000 + i, 1, "a", (BASE * 9)[: 300 + i] + "z.", None) for i in range(60)]
    assert {k for k, v in found(spark, rows + longer).items() if v == "spike"} == set()


def test_limits_and_lengths_beside(spark):
    rows, _, _ = _values()
    df = spark.createDataFrame([(i, c, o, a, b, "clash", "clash") for i, c, o, a, b in rows], ROW)
    lim = spark.createDataFrame([("1", 64), ("2", 9)], "source string, max_tokens long")
    got = {(x["source_kind"], x["measure"], x["length"], x["max_tokens"]) for x in T.field_limits(df, "id", ["intro", "closing"], ["cfg", "origin"], lim).collect()}
    assert got == {("cfg", "chars", 255, 64), ("cfg", "bytes", 255, 64), ("origin", "chars", 255, None), ("origin", "bytes", 255, None)}


def test_empty_repeated_and_long(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None, None, "", "  \n"), (2, 1, "x", None, None)]) == {}
    got = spark.createDataFrame([(1, 1, "a", "cut of […]", None, "", "")] * 2 + [(2, 1, "a", BASE * 5000 + "and `the", None, "", "")], ROW)
    assert sorted(x["id"] for x in T.find_truncated(got, "id", ["intro"], ["cfg"]).collect()) == [1, 1, 2]
    rates = {(x["source"], x["field_name"]): x["rate"] for x in T.truncation_rates(got, T.find_truncated(got, "id", ["intro", "closing"], ["cfg"]), ["intro", "closing"], "cfg").collect()}
    assert rates == {("1", "intro"): 1.0}
