"""Source files that do not parse.

Every file is cut at line ends into pieces of PIECE characters. A piece is summed up as a lexer-state map (entry state
to exit state) and the brackets it leaves open or closes too many of; both combine associatively: within a stretch of
STRETCH pieces where the text is read, and between the stretches of a file through a shuffle of the maps alone, first
in groups of neighbouring stretches and then over the groups. The fold tells the state and the brackets in which each
stretch begins; its statements are then parsed by the local grammar of the language (Python's by its own). Statements
that lie in several stretches are put together and parsed likewise, so no step needs a file as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import grammars, lexers
from codeloom.llm.handwritten import language_of
from codeloom.session import materialize, partitions, spread

PIECE, STRETCH, GROUP = 2048, 4, 64
_TAG = re.compile(r"<\?(?:php\b|=)?")


def php_code(text: str) -> str | None:
    """The code of a PHP file; what lies outside its tags is text. None: there is no code."""
    if "<?" not in text:
        return None
    out, at = [], 0
    while (m := _TAG.search(text, at)) is not None:
        end = text.find("?>", m.end())
        out.append(text[m.end() : end if end >= 0 else len(text)])
        if end < 0:
            break
        out.append(";")
        at = end + 2
    return "\n".join(out)


def prepare(content: str, language: str) -> str:
    """The text that the lexer reads: without byte order mark, with plain line ends, of PHP the code alone."""
    text = content.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    return (php_code(text) or "") if language == "php" else text


def follow(parts: list[str], language: str, state: str = lexers.CODE, stack: list[str] | None = None, before: str = "") -> dict:
    """Pieces in a row from a known entry: their maps are taken at the one state that occurs, and joined."""
    stack, whole, tokens, at, base = list(stack or []), None, [], [], 0
    for part in parts:
        r = lexers.lex(part, language, state, stack, before)
        tokens += r["tokens"]
        at += [base + x for x in r["at"]]
        base += len(part)
        one = {k: r[k] for k in ("exit", "open", "close", "error", "unsure")} | {"unsure": False}
        whole = one if whole is None else lexers.join(whole, one)
        for c in r["close"]:
            if stack and lexers.pairs(stack[-1], c):
                stack.pop()
        stack += r["open"]
        state, before = r["exit"], r["last"]
    return {"tokens": tokens, "at": at, "whole": whole, "stack": stack, "last": before}


def segments(text: str, tokens: list, at: list[int], language: str, stack: list[str], begins: bool) -> list[tuple[int, int, int, int, list[str]]]:
    """(first token, last + 1, first character, last + 1, brackets open before) of the runs between boundaries."""
    cuts = grammars.boundaries(tokens, at, text, language, stack, begins)
    marks = sorted({0, *cuts, len(tokens)})
    out, open_ = [], list(stack)
    for a, b in zip(marks, marks[1:]):
        begin = 0 if a == 0 else text.rfind("\n", 0, at[a]) + 1
        end = len(text) if b == len(tokens) else text.rfind("\n", 0, at[b]) + 1
        out.append((a, b, begin, end, list(open_)))
        part = tokens[a:b]
        own, close = lexers.balance(part, language)
        for c in close:
            if open_ and lexers.pairs(open_[-1], c):
                open_.pop()
        open_ += own
    return out


def _grammar(text: str, tokens: list, at: list[int], language: str, stack: list[str], first: bool) -> str | None:
    """What is wrong with whole statements in a row."""
    for a, b, begin, end, open_ in segments(text, tokens, at, language, stack, True):
        if bad := grammars.check(text[begin:end], tokens[a:b], language, first and a == 0, len(open_)):
            return bad
    return None


def judge(content: str, language: str, piece: int = PIECE) -> str | None:
    """What is wrong with a file read at one go, piece by piece; None if nothing."""
    return judged(prepare(content, language), language, piece)


def judged(text: str, language: str, piece: int = PIECE) -> str | None:
    if not text.strip():
        return None
    r = follow(lexers.pieces(text, piece), language)
    return lexers.verdict(r["whole"]) or _grammar(text, r["tokens"], r["at"], language, [], True)


def _read(piece: int, stretch: int):
    """One row a file that is one stretch, with what is wrong; else one row a stretch with its text and entry states."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, language, content in zip(pdf["file_id"], pdf["language"], pdf["content"]):
                text = prepare(content, language)
                if len(text) <= piece * stretch:
                    rows.append((file_id, language, 0, None, None, judge(content, language, piece)))
                    continue
                states, parts = lexers.states(language, text), lexers.pieces(text, piece)
                rows += [(file_id, language, k // stretch, "".join(parts[k : k + stretch]), states if k else [lexers.CODE], None) for k in range(0, len(parts), stretch)]
            yield pd.DataFrame(rows, columns=["file_id", "language", "k", "text", "states", "error"]).astype({"k": "int32"})

    return run


def _mapped(piece: int):
    """The map of each stretch, folded over its pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps = []
            for language, text, states in zip(pdf["language"], pdf["text"], pdf["states"]):
                later = lexers.states(language, text) if len(states) == 1 else list(states)
                own = [lexers.summary(part, language, later if i else list(states)) for i, part in enumerate(lexers.pieces(text, piece))]
                maps.append(json.dumps(reduce(lexers.combine, own)))
            yield pd.DataFrame({"file_id": pdf["file_id"], "grp": pdf["k"] // GROUP, "k": pdf["k"], "map": maps})

    return run


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The map of neighbouring stretches (``maps`` in order)."""
    for pdf in batches:
        yield pd.DataFrame({"file_id": pdf["file_id"], "grp": pdf["grp"], "map": [json.dumps(reduce(lexers.combine, map(json.loads, ms))) for ms in pdf["maps"]]})


def _walk(start: dict, maps: Iterable[str]) -> tuple[list[str], dict]:
    """The entry (what all before do together) of each map in order, and what all of them do."""
    entries, x = [], start
    for m in map(json.loads, maps):
        entries.append(json.dumps(x))
        y = m.get(x["exit"])
        x = x | {"unsure": True} if y is None else lexers.join(x, y)
    return entries, x


_START = {"exit": lexers.CODE, "open": [], "close": [], "error": None, "unsure": False}


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of the maps in order, from ``entry`` on where there is one, and what all of them do."""
    for pdf in batches:
        starts = map(json.loads, pdf["entry"]) if "entry" in pdf else [_START] * len(pdf)
        walked = [_walk(x, ms) for x, ms in zip(starts, pdf["maps"])]
        yield pd.DataFrame({"file_id": pdf["file_id"], "ks": pdf["ks"], "entries": [e for e, _ in walked], "whole": [json.dumps(x) for _, x in walked]})


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        x = [json.loads(e) for e in pdf["whole"]]
        yield pd.DataFrame({"file_id": pdf["file_id"], "error": [None if e["unsure"] else lexers.verdict(e) for e in x], "unsure": [e["unsure"] for e in x]})


def _statements(piece: int):
    """Of each stretch the first error in its whole statements, and the text before its first and from its last boundary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, language, k, text, entry in zip(pdf["file_id"], pdf["language"], pdf["k"], pdf["text"], pdf["entry"]):
                x = json.loads(entry)
                r = follow(lexers.pieces(text, piece), language, x["exit"], x["open"])
                parts = segments(text, r["tokens"], r["at"], language, x["open"], k == 0) or [(0, 0, 0, len(text), x["open"])]
                heads = set(grammars.boundaries(r["tokens"], r["at"], text, language, x["open"], k == 0))
                if not heads:
                    rows.append((file_id, language, k, False, k == 0, text, x["exit"], x["open"], None))
                    continue
                error = None
                for i, (a, b, begin, end, open_) in enumerate(parts):
                    if a not in heads:
                        rows.append((file_id, language, k, False, k == 0, text[begin:end], x["exit"], x["open"], None))
                    elif i == len(parts) - 1:
                        rows.append((file_id, language, k, True, k == 0 and a == 0, text[begin:end], lexers.CODE, open_, None))
                    else:
                        error = error or grammars.check(text[begin:end], r["tokens"][a:b], language, k == 0 and a == 0, len(open_))
                if error:
                    rows.append((file_id, language, k, True, False, None, None, None, error))
            yield pd.DataFrame(rows, columns=["file_id", "language", "k", "begins", "first", "text", "state", "stack", "error"]).astype({"k": "int32"})

    return run


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Statements that lie in several stretches."""
    for pdf in batches:
        errors = []
        for language, parts in zip(pdf["language"], pdf["parts"]):
            text, stack = "".join(x["text"] for x in parts), list(parts[0]["stack"])
            r = follow(lexers.pieces(text, PIECE), language, parts[0]["state"], stack)
            errors.append(_grammar(text, r["tokens"], r["at"], language, stack, bool(parts[0]["first"])))
        yield pd.DataFrame({"file_id": pdf["file_id"], "error": errors})


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"file_id": pdf["file_id"], "error": [judged(t, x) for t, x in zip(pdf["text"], pdf["language"])]})


def parse_errors(files: DataFrame, piece: int = PIECE, stretch: int = STRETCH) -> DataFrame:
    """``file_id, error`` of every file that its language rejects.

    ``files`` has ``file_id`` (unique), ``file_path``, ``content``. The language is that of the extension; files of
    unknown extension, null or empty files, and such of white space or comments only are valid. Line ends and byte
    order marks do not matter. ``piece`` and ``stretch`` change the work of a task, not the result. Where a template of
    JavaScript within a template's substitution lies across a piece's end, the maps cannot tell (``unsure``), and the
    file is followed from its start.
    """
    f = files.select("file_id", language_of(F.col("file_path")).alias("language"), "content").where("language is not null and content is not null")
    schema = "file_id long, language string, k int, text string, states array<string>, error string"
    rows = materialize(spread(f).mapInPandas(_read(piece, stretch), schema).where("text is not null or error is not null"))
    decided, long = rows.where("error is not null").select("file_id", "error"), rows.where("text is not null")
    # the stretches of a long file are spread over all tasks before the costly part
    n = max(partitions(files.sparkSession), files.sparkSession.sparkContext.defaultParallelism)
    maps = materialize(long.select("file_id", "language", "k", "text", "states").repartition(n, "file_id", "k").mapInPandas(_mapped(piece), "file_id long, grp int, k int, map string"))

    def gathered(df: DataFrame, by: list[str], k: str) -> DataFrame:
        """The maps of neighbours in order: at most GROUP of them, or one for each GROUP stretches of a file."""
        rows = F.array_sort(F.collect_list(F.struct(k, "map")))
        return df.groupBy(*by).agg(rows.alias("r")).select(*by, F.col(f"r.{k}").alias("ks"), F.col("r.map").alias("maps"))

    walked = "file_id long, ks array<int>, entries array<string>, whole string"
    by_group = gathered(maps, ["file_id", "grp"], "k")
    groups = by_group.select("file_id", "grp", "maps").mapInPandas(_fold, "file_id long, grp int, map string")
    groups = materialize(gathered(groups, ["file_id"], "grp").mapInPandas(_entries, walked))
    each = lambda df, k: df.select("file_id", F.explode(F.arrays_zip("ks", "entries")).alias("e")).select("file_id", F.col("e.ks").alias(k), F.col("e.entries").alias("entry"))
    folded = materialize(groups.mapInPandas(_verdicts, "file_id long, error string, unsure boolean"))
    entries = each(by_group.join(each(groups, "grp"), ["file_id", "grp"]).select("file_id", "ks", "maps", "entry").mapInPandas(_entries, walked), "k")
    good = folded.where("error is null and not unsure").select("file_id")
    todo = long.select("file_id", "language", "k", "text").join(entries, ["file_id", "k"]).join(good, "file_id", "left_semi")
    schema = "file_id long, language string, k int, begins boolean, first boolean, text string, state string, stack array<string>, error string"
    parts = materialize(todo.select("file_id", "language", "k", "text", "entry").mapInPandas(_statements(piece), schema))
    # a piece of text that begins no statement goes on with the last one begun before it
    order = Window.partitionBy("file_id").orderBy("k", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = parts.where("error is null").withColumn("statement", F.last(F.when(F.col("begins"), F.col("k")), ignorenulls=True).over(order))
    one = open_.groupBy("file_id", "language", "statement").agg(F.array_sort(F.collect_list(F.struct("k", "begins", "first", "text", "state", "stack"))).alias("parts"))
    across = one.select("file_id", "language", "parts").mapInPandas(_joined, "file_id long, error string").where("error is not null")
    within = parts.where("error is not null").select("file_id", "error")
    again = long.join(folded.where("unsure").select("file_id"), "file_id", "left_semi").groupBy("file_id", "language").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("r"))
    unsure = again.select("file_id", "language", F.array_join("r.text", "").alias("text")).mapInPandas(_whole, "file_id long, error string").where("error is not null")
    by_stretch = folded.where("error is not null").select("file_id", "error").unionByName(within).unionByName(across).groupBy("file_id").agg(F.min("error").alias("error"))
    return decided.unionByName(by_stretch).unionByName(unsure)


def error_rates(files: DataFrame, errors: DataFrame) -> DataFrame:
    """``repo, language, n_files, n_errors, rate`` by repository and language of the extension."""
    f = files.select("file_id", "repo", language_of(F.col("file_path")).alias("language")).join(errors.select("file_id", F.lit(1).alias("bad")), "file_id", "left")
    g = f.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_errors"))
    return g.withColumn("rate", F.round(F.col("n_errors") / F.col("n_files"), 6))
