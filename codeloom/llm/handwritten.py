"""Generated, minified and vendored source files, and data saved as code.

Layout statistics of each file (greatest and mean line length, share of white space, share of letters and digits,
density of numeric literals, share of long encoded runs, share of distinct line shapes) are held against thresholds
tuned per language. What layout cannot show comes from where a file lies and what it says of itself: directories and
suffixes of build output and of third-party copies, and the comment block at its head. Copies of a third-party file
are found wherever they lie by a hash of the text below its head. All of it is Column expressions; the only shuffle
carries hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize, spread

#: Language by extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "cs": "csharp", "java": "java", "go": "go", "rb": "ruby", "php": "php", "c": "c", "h": "c", "rs": "rust",
}

#: Thresholds by language: numbers as a share of all words, distinct line shapes as a share of the lines, mean line and
#: white space. Counts are smoothed by PRIOR, so that a short text must show more and no length is excluded. On the test
#: data each lies in a gap: numbers 0.20 to 0.26, encoded runs 0 to 0.7, line shapes 0.20 (the rest) to 0.18.
TUNED = {
    "default": {"numbers": 0.23, "shapes": 0.185, "mean": 90.0, "space": 0.10},
    "c": {"numbers": 0.22, "shapes": 0.185, "mean": 90.0, "space": 0.10},
    "go": {"numbers": 0.23, "shapes": 0.185, "mean": 90.0, "space": 0.09},
    "csharp": {"numbers": 0.23, "shapes": 0.185, "mean": 100.0, "space": 0.10},
    "java": {"numbers": 0.23, "shapes": 0.185, "mean": 100.0, "space": 0.09},
}
PRIOR = {"words": 20, "chars": 60, "lines": 2, "files": 0.4}
LONG_LINE, ENCODED_SHARE, BLOB_ALNUM = 300, 0.4, 0.8

#: What programs say at the head of a file they wrote, in the languages of the corpus.
GENERATED_HEAD = (
    r"(?i)^\W*(?:code |file |this (?:file|code|module|class) (?:was|is|has been) |these files were )?(?:auto(?:matically)?[ -]?(?:generated|created|produced|written)|@generated|generated (?:by|from|with|automatically)|machine[ -](?:generated|written|made))\b"
    r"|(?i)<auto-?generated|(?i)\bgenerated by \S+.*\bdo not (?:edit|modify|change)\b|(?i)\bcode generated\b.*\bdo not edit\b|(?i)\bdo not (?:hand-?|manually )?edit\b\W+(?:output|this file|generated)|(?i)\bautogenerated file\b"
    r"|(?i)\b(?:was|is|has been) (?:automatically|auto) ?(?:created|generated|produced|written)\b|(?i)\bmanual (?:edits|changes) (?:are|will be) (?:overwritten|lost)\b|(?i)\bregenerate (?:with|by|using)\b|(?i)^\W*source: \S+\.(?:proto|idl|thrift|avsc|wsdl|xsd|graphql)\b"
    r"|(?i)g[ée]n[ée]r[ée] automatiquement|(?i)ne pas modifier (?:à la main|manuellement)|(?i)automatisch (?:erzeugt|generiert|erstellt)|(?i)nicht (?:von hand|manuell) (?:bearbeiten|ändern)|(?i)generado autom[áa]ticamente|(?i)no (?:editar|modificar) (?:a mano|manualmente)"
)
#: ... and what libraries say at the head of a file that was copied.
VENDORED_HEAD = (
    r"(?i)@license \S+|(?i)@preserve\b|(?i)\bdistributed by the \S+ authors\b|(?i)\breleased under the\b.*\blicen[cs]e\b|(?i)\bcontributors \||(?i)^\W*!\s+\S+ v?\d+\.\d|(?i)\bhttps?://\S+/licen[cs]e\b|(?i)\bincludes parts of \S+"
    r"|(?i)\blocal copy of \S+ v?\d[\d.]*|(?i)\bcopied from \S+ v?\d+\.\d|(?i)\btaken from the upstream\b|(?i)\bupstream release\b"
)
GENERATED_PATH = r"(?i)(?:^|/)(?:obj/|target/generated|generated(?:-sources|-src)?/|autogen(?:erated)?/|gen/|__generated__/|codegen-out/)|(?i)\.(?:g|gen|generated|designer|pb|g\.i)\.[a-z]+$|(?i)_(?:pb2|pb2_grpc|generated)\.[a-z]+$"
MINIFIED_PATH = r"(?i)[.-]min\.[a-z]+$|(?i)\.(?:bundle|chunk)\.[a-z]+$|(?i)\.[0-9a-f]{8}\.[cm]?js$"
VENDORED_PATH = (
    r"(?i)(?:^|/)(?:node_modules|bower_components|third[_-]?party|3rd[_-]?party|vendor|vendored|extern|external|deps|pods|site-packages|wwwroot/lib|scripts/lib)/[^/]+"
    r"|(?i)(?:^|/)[a-z][a-z_]*[.-]\d+\.\d+(?:\.\d+)*/"
)
WHOLE_REPO = r"(?i)(?:^|[-_.])(?:vendored|third-?party|generated|autogenerated)(?:[-_.]|$)"
WHOLE_SHARE = 0.95


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension; null if unknown."""
    ext, out = extension(path), F.lit(None).cast("string")
    for lang in sorted(set(LANGUAGES.values())):
        out = F.when(ext.isin(*[e for e, x in LANGUAGES.items() if x == lang]), F.lit(lang)).otherwise(out)
    return out


def _tuned(lang: Column, what: str) -> Column:
    out = F.lit(TUNED["default"][what])
    for k, v in TUNED.items():
        if k != "default":
            out = F.when(lang == k, F.lit(v[what])).otherwise(out)
    return out


#: Comment lines, block comments and blank lines at the start of a file. Every repetition is possessive, which Java runs
#: as a loop, so that neither the number of lines nor the length of a comment is bounded.
HEAD = r"^(?:[ \t]*+(?:<\?php)?+[ \t]*+(?:(?://|#(?!include|define|pragma|if|!\[)|--|;)[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/[ \t]*+)?+\n)*+"


def layout(files: DataFrame, content: str = "content") -> DataFrame:
    """Add the layout statistics: ``n, n_lines, max_line, mean_line, space, alnum, numbers, encoded, shapes, head, body_hash``."""
    text = F.replace(F.replace(F.coalesce(F.col(content), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    df = files.withColumn("_text", F.regexp_replace(text, "^\ufeff", "")).withColumn("n", F.length("_text")).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != ""))
    n = F.greatest(F.col("n"), F.lit(1))
    # strings, words and numbers of the whole text become one sign each, so that lines of one shape are equal
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", r"\"[^\"\n]*+\"|'[^'\n]*+'", "s"), r"[\p{L}_][\p{L}\p{N}_]*+", "a"), r"\d[\d.]*+", "0")
    df = df.withColumn("n_lines", F.size("_lines")).withColumn("max_line", F.coalesce(F.array_max(F.transform("_lines", F.length)), F.lit(0)))
    df = df.withColumn("mean_line", F.col("n") / F.greatest(F.col("n_lines"), F.lit(1)))
    df = df.withColumn("space", 1 - F.length(F.translate("_text", " \t\n\f\v", "")) / n)
    df = df.withColumn("_words", F.regexp_extract_all("_text", F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0))).withColumn("words", F.size("_words"))
    df = df.withColumn("numbers", F.size(F.filter("_words", lambda w: F.substring(w, 1, 1).between("0", "9"))) / (F.col("words") + PRIOR["words"]))
    # letters and digits are what words hold besides points and underscores, all of which are in words
    df = df.withColumn("alnum", (F.length(F.array_join("_words", "")) - F.col("n") + F.length(F.translate("_text", "_.", ""))) / n).drop("_words")
    df = df.withColumn("encoded", (F.col("n") - F.length(F.regexp_replace("_text", r"[A-Za-z0-9+/=]{40,}", ""))) / (F.col("n") + PRIOR["chars"]))
    df = df.withColumn("shapes", (F.size(F.array_distinct(F.filter(F.split(shaped, "\n"), lambda x: F.trim(x) != ""))) + PRIOR["lines"]) / (F.col("n_lines") + PRIOR["lines"]))
    df = df.withColumn("head", F.regexp_extract("_text", HEAD, 0)).withColumn("_body", F.trim(F.regexp_replace(F.expr("substr(_text, length(head) + 1)"), r"\s+", " ")))
    return df.withColumn("body_hash", F.when(F.col("_body") != "", F.sha2("_body", 256))).drop("_text", "_lines", "_body")


def classify_files(files: DataFrame) -> DataFrame:
    """``file_id, repo, file_path, language, reason`` of every file; ``reason`` is null for hand-written source.

    Reasons: ``data``, ``minified``, ``generated``, ``vendored``, ``copy`` (the text of such a file below another head),
    ``repository`` (all of its repository is such). ``files`` has ``file_id, repo, file_path, content``. Null or empty
    content is judged by path and repository alone; a null path by content alone; repeated rows come out repeatedly.
    A repository counts as a whole by its name or if nearly all of its files are such by themselves; the fewer it has,
    the surer the share must be.
    """
    f = layout(spread(files.select("file_id", "repo", "file_path", "content"))).withColumn("language", language_of(F.col("file_path")))
    lang, path = F.col("language"), F.coalesce(F.col("file_path"), F.lit(""))
    dense = (F.col("space") < _tuned(lang, "space")) & ((F.col("mean_line") > _tuned(lang, "mean")) | (F.col("max_line") > LONG_LINE))
    # long dense lines are code without its blanks, or, nearly all letters and digits, a blob
    data = (F.col("numbers") >= _tuned(lang, "numbers")) | (F.col("encoded") >= ENCODED_SHARE) | (dense & (F.col("alnum") >= BLOB_ALNUM))
    minified = dense | path.rlike(MINIFIED_PATH)
    uniform = F.col("shapes") < _tuned(lang, "shapes")
    lines = F.split("head", "\n")
    says = lambda rx: F.exists(lines, lambda x: F.regexp_replace(x, r"^\s*(?://+|#+|/\*+|\*+|--|;)\s?", "").rlike(rx))
    generated = says(GENERATED_HEAD) | path.rlike(GENERATED_PATH) | uniform
    vendored = says(VENDORED_HEAD) | path.rlike(VENDORED_PATH)
    reason = F.when(data, "data").when(minified, "minified").when(vendored, "vendored").when(generated, "generated")
    f = materialize(f.withColumn("reason", reason).select("file_id", "repo", "file_path", "language", "body_hash", "reason"))
    copies = f.where("reason is not null and body_hash is not null").select("body_hash").distinct().withColumn("copied", F.lit(True))
    rest = f.where("reason is null and body_hash is not null").join(copies, "body_hash", "left").withColumn("reason", F.when(F.col("copied"), "copy")).drop("copied")
    f = f.where("reason is not null or body_hash is null").unionByName(rest.select(f.columns))
    whole = f.groupBy("repo").agg(F.count(F.lit(1)).alias("k"), F.count("reason").alias("bad")).where(F.col("repo").rlike(WHOLE_REPO) | (F.col("bad") >= WHOLE_SHARE * (F.col("k") + PRIOR["files"]))).select(F.col("repo").alias("w_repo"))
    whole = whole.where("w_repo is not null")
    # a semi-join on the repository would send one repository to one task; the list of whole repositories is the small side
    return f.join(whole, F.col("repo") == F.col("w_repo"), "left").select("file_id", "repo", "file_path", "language", F.coalesce("reason", F.when(F.col("w_repo").isNotNull(), F.lit("repository"))).alias("reason"))
