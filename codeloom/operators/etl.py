"""From files to nodes, edges and inventories."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.kernels import bytes_head, next_route, normalize_route
from codeloom.session import is_empty, materialize, partitions, spread

#: Languages by extension, folders that are not scanned, the greatest file.
LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "kt": "kotlin", "swift": "swift", "cshtml": "razor"}
SKIPPED = r"(?:^|/)(?:obj|bin|node_modules|packages)/"
MOST_BYTES = 2_000_000
TODO = r"^\s*(?://|/\*|#|--|<!--|;|\*+)\s*(TODO|FIXME|HACK|XXX)(?![\p{L}\p{N}_])[:(\s]*(.*)$"
#: Objects and methods that declare routes in Node.js and Python web frameworks, and Spring's annotations.
ROUTERS = {"express": ("app", "router", "api"), "python": ("app", "router", "api", "blueprint", "bp")}
VERBS = {"express": ("get", "post", "put", "delete", "patch", "options", "head", "all"), "python": ("get", "post", "put", "delete", "patch", "options", "head", "route")}
MAPPINGS = ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping")
#: What reads an environment variable by a quoted name, and what also has variables as members.
ENV_READERS = ("process.env", "os.getenv", "os.environ", "Environment.GetEnvironmentVariable", "Configuration", "System.getenv")
ENV_MEMBERS = ("process.env",)
#: Folders of build output and dependencies, which the inventories leave out.
NO_CONFIG = ("node_modules", "target", "dist", "build", "vendor")
#: A dotted callee and, group 2, the text that is its first argument or its argument ``value``.
CALL_WITH_TEXT = r"""(@?\s*[\w$]+(?:\s*\.\s*[\w$]+)*)\s*\((?:[^()"'`]*\bvalue\s*=)?\s*["'`]([^"'`]+)["'`]"""
CHUNK_BYTES = 6000
TIERS = (("field_type", 0.85), ("static_class", 0.8), ("same_file", 1.0), ("named_import", 0.95), ("import_scoped", 0.8), ("package_scoped", 0.7), ("global", 0.5))


def language(path: Column) -> Column:
    ext, out = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)), F.lit(None).cast("string")
    for lang in sorted(set(LANGUAGES.values())):
        out = F.when(ext.isin(*[e for e, x in LANGUAGES.items() if x == lang]), lang).otherwise(out)
    return out


def scan(files: DataFrame) -> DataFrame:
    """``path, content, size, language`` of the files worth parsing: known language, no build folder, not too large."""
    f = files.select("path", "content", F.octet_length("content").cast("long").alias("size"), language(F.col("path")).alias("language"))
    return f.where(F.col("language").isNotNull() & ~F.col("path").rlike(SKIPPED) & (F.col("size") <= MOST_BYTES))


def byte_chunks(files: DataFrame, most: int = 20_000_000) -> DataFrame:
    """``files`` with ``chunk``: files in the order of their paths fill chunks of about ``most`` bytes of ``size``.

    Ranges of paths are summed first, so the running total needs one small window over the ranges and one within each.
    """
    n = files.sparkSession.sparkContext.defaultParallelism * 4
    r = files.repartitionByRange(n, "path").withColumn("_range", F.spark_partition_id())
    r = materialize(r)
    sums = r.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    before = sums.select(F.col("_range").alias("_r"), (F.sum("_bytes").over(Window.orderBy("_range")) - F.col("_bytes")).alias("_before"))  # at most n rows
    inside = F.sum("size").over(Window.partitionBy("_range").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return r.withColumn("_inside", inside).join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn("chunk", F.floor((F.col("_before") + F.col("_inside")) / most)).drop("_range", "_r", "_before", "_inside")


def structure(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File and Folder nodes of ``path`` and the CONTAINS edges between them."""
    parts = paths.select("path", F.split("path", "/").alias("p")).distinct()
    up = parts.select(F.posexplode("p").alias("i", "name"), "p").select((F.col("i") + 1 == F.size("p")).alias("leaf"), "name", F.array_join(F.slice("p", 1, F.col("i") + 1), "/").alias("file_path"), F.array_join(F.slice("p", 1, F.col("i")), "/").alias("parent"), "i").distinct()
    kind = F.when(F.col("leaf"), "File").otherwise("Folder")
    nodes = up.select(F.concat_ws(":", kind, "file_path").alias("id"), kind.alias("label"), "name", "file_path")
    src, dst = F.concat(F.lit("Folder:"), F.col("parent")), F.concat_ws(":", kind, "file_path")
    edges = up.where("i > 0").select(F.concat_ws("|", src, F.lit("CONTAINS"), dst).alias("id"), src.alias("source_id"), dst.alias("target_id"), F.lit("CONTAINS").alias("type"))
    return nodes, edges


def lines(files: DataFrame, path: str = "file_path") -> DataFrame:
    """``<path>, line, text``: numbered lines, from 1."""
    return files.select(path, F.posexplode(F.split("content", "\r\n|\r|\n")).alias("i", "text")).select(path, (F.col("i") + 1).cast("long").alias("line"), "text")


def file_slice(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    return lines(files.where(F.col("file_path") == path)).where(F.col("line").between(start, end))


def todos(files: DataFrame) -> DataFrame:
    """``file_path, line, kind, text``: markers behind a comment start, one a line, text up to 500 bytes."""
    t = lines(files).where(F.col("text").rlike(TODO))
    return t.select("file_path", "line", F.regexp_extract("text", TODO, 1).alias("kind"), F.rtrim(bytes_head(F.regexp_extract("text", TODO, 2), 500)).alias("text"))


def todo_order(df: DataFrame) -> DataFrame:
    rank = F.when(F.col("kind") == "FIXME", 0).when(F.col("kind") == "HACK", 1).when(F.col("kind") == "TODO", 2).otherwise(3)
    return df.orderBy(rank, "file_path", "line")


def endpoints(files: DataFrame) -> DataFrame:
    """``framework, http_method, route, file_path, line``; the first of a method and route counts."""
    t = lines(files)
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(CALL_WITH_TEXT), F.lit(1)).alias("callee"), F.regexp_extract_all("text", F.lit(CALL_WITH_TEXT), F.lit(2)).alias("route"))
    calls = t.select("file_path", "line", "text", F.explode(both).alias("c")).select("file_path", "line", "text", F.regexp_replace("c.callee", r"\s", "").alias("callee"), "c.route")
    marked, parts = F.col("callee").startswith("@"), F.split(F.regexp_replace("callee", "^@", ""), r"\.")
    calls = calls.withColumn("name", F.element_at(parts, -1)).withColumn("owner", F.when(F.size(parts) > 1, F.element_at(parts, -2)))
    ext = F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1))
    routed = lambda kind: F.col("owner").isin(*ROUTERS[kind]) & F.col("name").isin(*VERBS[kind])
    framework = F.when(ext.rlike("^[cm]?[jt]sx?$") & ~marked & routed("express"), "express").when((ext == "py") & marked & F.ltrim("text").startswith("@") & routed("python"), "python").when(ext.isin("java", "kt") & marked & F.col("name").isin(*MAPPINGS), "spring")
    web = calls.withColumn("framework", framework).where("framework is not null").withColumn("verb", F.upper(F.regexp_replace("name", "Mapping$", "")))
    stated = F.nullif(F.regexp_extract("text", r"RequestMethod\.(\w+)", 1), F.lit(""))
    method = F.when(F.col("verb") == "REQUEST", F.coalesce(stated, F.lit("GET"))).when(F.col("verb") == "ROUTE", "GET").otherwise(F.col("verb"))
    web = web.select("framework", method.alias("http_method"), normalize_route(F.col("route")).alias("route"), "file_path", "line")
    app = t.where(F.col("file_path").rlike(r"(?:^|/)app/(?:.*/)?route\.[jt]sx?$") & F.col("text").rlike(r"^\s*export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"))
    app = app.select(F.lit("next").alias("framework"), F.regexp_extract("text", r"function\s+(\w+)", 1).alias("http_method"), next_route(F.col("file_path")).alias("route"), "file_path", "line")
    k = F.row_number().over(Window.partitionBy("http_method", "route").orderBy("file_path", "line"))
    return web.unionByName(app).withColumn("k", k).where("k = 1").drop("k")


def filter_endpoints(e: DataFrame, method: str | None = None, route: str | None = None) -> DataFrame:
    e = e.where(F.upper("http_method") == method.upper()) if method else e
    return e.where(F.lower("route").contains(route.lower())) if route else e


def env_inventory(files: DataFrame) -> DataFrame:
    """``name, declared_in, line, used_in_count, unused, undeclared``: the first declaration of a name counts.

    Declared are keys of .env files and config.toml (upper case), of properties files, the top level of application
    YAML files and the quoted keys that begin a line of appsettings JSON; used are names that the readers of other
    files ask for. ``used_in_count`` counts places.
    """
    folders = rf"(?i)(?:^|/)(?:{'|'.join(NO_CONFIG)})/"
    t = lines(files.where(~F.col("file_path").rlike(folders))).withColumn("file", F.lower(F.substring_index("file_path", "/", -1)))
    file, text = F.col("file"), F.col("text")
    kind = F.when((file == ".env") | file.startswith(".env."), "env").when(file.startswith("appsettings") & file.endswith(".json"), "json").when(file.endswith(".properties"), "properties")
    t = t.withColumn("kind", kind.when(file.isin("application.yml", "application.yaml"), "yaml").when(file.endswith("config.toml"), "env").otherwise("source"))
    left = F.trim(F.regexp_replace(F.substring_index("text", "=", 1), r"^\s*export\s+", ""))
    key = F.when((F.col("kind") == "env") & text.contains("=") & left.rlike("^[A-Z][A-Z0-9_]*$"), left)
    key = key.when((F.col("kind") == "properties") & text.contains("=") & left.rlike(r"^[A-Za-z][\w.-]*$"), left)
    key = key.when((F.col("kind") == "yaml") & text.contains(":") & text.rlike(r"^[A-Za-z][\w-]*\s*:"), F.trim(F.substring_index("text", ":", 1)))
    key = key.when((F.col("kind") == "json") & F.ltrim("text").startswith('"'), F.nullif(F.substring_index(F.substring_index("text", '"', 2), '"', -1), F.lit("")))
    decl = t.where("kind <> 'source'").select(key.alias("name"), F.struct("file_path", "line").alias("at")).where("name is not null").groupBy("name").agg(F.min("at").alias("at"))
    quoted = rf"""(?:{'|'.join(map(re.escape, ENV_READERS))})\s*[(\[]\s*["']([^"']+)["']"""
    member = rf"(?:{'|'.join(map(re.escape, ENV_MEMBERS))})\.([A-Z][A-Z0-9_]*)"
    names = F.concat(*(F.regexp_extract_all("text", F.lit(rx), F.lit(1)) for rx in (quoted, member)))
    used = t.where("kind = 'source'").select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("used_in_count"))
    j = decl.join(used, "name", "full_outer")
    return j.select("name", F.col("at.file_path").alias("declared_in"), F.col("at.line").alias("line"), F.coalesce("used_in_count", F.lit(0)).alias("used_in_count"), F.col("used_in_count").isNull().alias("unused"), F.col("at").isNull().alias("undeclared"))


_TABLE = re.compile(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\(")
_NO_COLUMN = re.compile(r"(?i)^(?:primary|foreign|unique|constraint|check|key|index)\b")


def parse_ddl(text: str) -> list[tuple]:
    """(table, column, type, primary key, nullable, referenced table) of CREATE TABLE statements."""
    out, clean = [], lambda s: s.strip("\"`[] ")
    text = re.sub(r"--[^\n]*|/\*[\s\S]*?\*/", " ", text or "")
    for m in _TABLE.finditer(text):
        depth, at, parts, start = 1, m.end(), [], m.end()
        while at < len(text) and depth:
            c = text[at]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or not depth:
                parts.append(text[start:at].strip())
                start = at + 1
            at += 1
        keys, refs, cols = set(), {}, []
        for p in parts:
            low = p.lower()
            if k := re.search(r"(?i)primary\s+key\s*\(([^)]*)\)", p):
                keys |= {clean(x).lower() for x in k[1].split(",")}
            if f := re.search(r"(?i)foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.\"`\[\]]+)", p):
                refs |= {clean(x).lower(): clean(f[2]) for x in f[1].split(",")}
            if p and not _NO_COLUMN.match(p):
                w = re.match(r"(\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|\w+)\s+(\w+(?:\s*\([^)]*\))?)", p)
                if w:
                    r = re.search(r"(?i)\breferences\s+([\w.\"`\[\]]+)", p)
                    cols.append((clean(w[1]), w[2], "primary key" in low, "not null" not in low and "primary key" not in low, clean(r[1]) if r else None))
        for name, kind, pk, nullable, ref in cols:
            pk = pk or name.lower() in keys
            out.append((clean(m[1]), name, kind, pk, nullable and not pk, ref or refs.get(name.lower())))
    return out


def parse_prisma(text: str) -> list[tuple]:
    """Columns of the models of a Prisma schema, in the form of :func:`parse_ddl`; fields of a model's type are links."""
    out, name, models = [], None, set(re.findall(r"(?m)^\s*model\s+(\w+)", text or ""))
    for raw in (text or "").splitlines():
        words = raw.split("//")[0].split()
        if name is None and len(words) > 1 and words[0] == "model":
            name = words[1].rstrip("{")
        elif words and words[0] == "}":
            name = None
        elif name and len(words) > 1 and not words[0].startswith("@"):
            kind = words[1].rstrip("?").removesuffix("[]")
            out.append((name, words[0], kind, "@id" in words, words[1].endswith("?"), kind if kind in models else None))
    return out


def _ddl(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(p, *r) for p, c in zip(pdf["file_path"], pdf["content"]) for r in (parse_prisma if str(p).endswith(".prisma") else parse_ddl)(c)]
        yield pd.DataFrame(rows, columns=["file_path", "table_name", "column_name", "column_type", "is_primary_key", "is_nullable", "references_table"])


def db_columns(files: DataFrame) -> DataFrame:
    """Columns of every CREATE TABLE statement in the files and of every model of Prisma schemas."""
    schema = "file_path string, table_name string, column_name string, column_type string, is_primary_key boolean, is_nullable boolean, references_table string"
    has = F.col("content").rlike(r"(?i)create\s+table") | (F.col("file_path").endswith(".prisma") & F.col("content").contains("model"))
    return files.select("file_path", "content").where(has).mapInPandas(_ddl, schema)


def mapped_classes(files: DataFrame) -> DataFrame:
    """``file_path, class_name, table_name``: classes that an object-relational mapper ties to a table.

    Python classes with a base Base, db.Model or declarative_base(), by their ``__tablename__`` or, without one, their
    name; TypeScript and JavaScript classes behind ``@Entity``, by its text or their name. The lines of a file are
    looked at in order: a table name belongs to the last class before it, an annotation to the next class.
    """
    t = lines(files.where(F.col("file_path").rlike(r"(?i)\.(?:py|ts|tsx|js)$")))
    text, py = F.col("text"), F.col("file_path").rlike(r"(?i)\.py$")
    head = F.regexp_extract("text", r"^\s*class\s+(\w+)\s*\(\s*(?:Base\b|db\.Model\b|declarative_base\()", 1)
    plain = F.regexp_extract("text", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", 1)
    t = t.withColumn("cls", F.nullif(F.when(py, head).otherwise(plain), F.lit(""))).withColumn("other", py & text.rlike(r"^\s*class\s") & (head == ""))
    t = t.withColumn("own", F.when(py & text.contains("__tablename__"), F.nullif(F.regexp_extract("text", r"""=\s*["']([^"']+)""", 1), F.lit(""))))
    t = t.withColumn("mark", F.when(~py & F.ltrim("text").startswith("@Entity"), F.struct("line", F.regexp_extract("text", r"""["'`]([^"'`]+)""", 1).alias("name"))))
    t = t.where("cls is not null or other or own is not null or mark is not null")
    before = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("k", F.sum(F.when(F.col("cls").isNotNull() | F.col("other"), 1).otherwise(0)).over(before)).withColumn("entity", F.last("mark", ignorenulls=True).over(before)).withColumn("prior", F.lag("mark").over(Window.partitionBy("file_path").orderBy("line")))
    found = t.groupBy("file_path", "k").agg(F.min("cls").alias("class_name"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("line"))).alias("own"), F.max_by("prior", F.when(F.col("cls").isNotNull(), F.col("line"))).alias("prior"), F.bool_or(py).alias("py"))
    found = found.where("class_name is not null and (py or prior is not null)")
    return found.select("file_path", "class_name", F.coalesce("own", F.nullif("prior.name", F.lit("")), "class_name").alias("table_name"))


def db_tables(columns: DataFrame) -> DataFrame:
    return columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"), F.count("references_table").alias("n_references"))


def manifest(files: DataFrame) -> DataFrame:
    """``path, hash, size``."""
    return files.select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: added, modified or removed."""
    j = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    return j.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").alias("change")).where("change is not null")


def chunk_markdown(text: str) -> list[tuple[str, str, int]]:
    """(title, content, index): a chunk a heading; bodies beyond CHUNK_BYTES split at blank lines; code stays whole."""
    title, body, out, code = "Document Start", [], [], False

    def flush(last: bool = False) -> None:
        content = "\n".join(body).strip()
        if content:
            parts = [content]
            if len(content.encode()) > CHUNK_BYTES:
                parts, cur = [], ""
                for p in content.split("\n\n"):
                    if cur and len(cur.encode()) + 2 + len(p.encode()) > CHUNK_BYTES:
                        parts.append(cur.strip())
                        cur = ""
                    cur = f"{cur}\n\n{p}" if cur else p
                if cur.strip():
                    parts.append(cur.strip())
            for i, p in enumerate(parts):
                out.append((f"{title} (part {i + 1}/{len(parts)})" if len(parts) > 1 else title, p, len(out)))
        elif last and title and (out or title != "Document Start"):
            out.append((title, "", len(out)))

    for line in (text or "").splitlines():
        if line.lstrip().startswith("```"):
            code = not code
        h = None if code else re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if h:
            flush()
            title, body = h[2], []
        else:
            body.append(line)
    flush(last=True)
    return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(s, t, c, i) for s, text in zip(pdf["source_path"], pdf["content"]) for t, c, i in chunk_markdown(text)]
        yield pd.DataFrame(rows, columns=["source_path", "title", "content", "chunk_index"]).astype({"chunk_index": "int32"})


def chunks(docs: DataFrame) -> DataFrame:
    """``source_path, title, content, chunk_index`` of Markdown documents (``source_path, content``)."""
    return spread(docs.select("source_path", "content")).mapInPandas(_chunks, "source_path string, title string, content string, chunk_index int")


def mentions(chunk: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source_path, chunk_index, id``: symbols that a chunk names as a whole word, of names of 5 letters and more.

    Chunks are cut into words, which join the names; a name of several words meets the chunks through its longest word
    and is then looked for as a whole. No text is searched for every name. Each chunk has a name once before the name's
    symbols join, so the pairs, which may be many more than chunks and symbols, are neither sorted nor shuffled; only
    those of ids with several names are made distinct.
    """
    parts = lambda c: F.split(c, r"[^\p{L}\p{N}_]+")
    key = ["source_path", "chunk_index"]
    n = materialize(nodes.where(F.col("label").isin("Class", "Method", "Function", "Interface", "Struct", "Controller", "Service") & (F.length("name") >= 5)).select("id", "name").distinct())
    w = chunk.select(*key, F.explode(F.array_distinct(parts("content"))).alias("word"))
    single = F.col("name").rlike(r"^[\p{L}\p{N}_]+$")
    slots = partitions(n.sparkSession)
    words = w.withColumnRenamed("word", "name").where(F.length("name") >= 5).repartition(slots, "name")
    named = [words.join(n.where(single).select("name").repartition(slots, "name").distinct(), "name", "left_semi").distinct()]
    if not is_empty(n.where(~single)):
        longest = F.element_at(F.array_sort(F.transform(parts("name"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)["x"]
        many = n.where(~single).select("name", longest.alias("word")).where("word <> ''").distinct()
        j = w.join(many, "word").join(chunk.select(*key, "content"), key)
        bound = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("name"), F.lit(r"\E(?![\p{L}\p{N}_])"))
        named.append(j.where(F.rlike("content", bound)).select("name", *key).distinct())
    several = n.groupBy("id").agg(F.count(F.lit(1)).alias("names")).where("names > 1").select("id")

    def pairs(n: DataFrame) -> DataFrame:
        found = [x.join(n.repartition(slots, "name"), "name").select(*key, "id") for x in named]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    if is_empty(several):
        return pairs(n)
    return pairs(n.join(several, "id", "left_anti")).unionByName(pairs(n.join(several, "id", "left_semi")).distinct())


SHORT_WORDS = 50


def short_sections(text: str) -> list[int]:
    """Lines of first and second level headings whose section, up to the next one of no lower rank, has few words."""
    rows = (text or "").splitlines()
    level = [len(m[1]) if (m := re.match(r"\s*(#+) ", r)) else 0 for r in rows]
    out, i = [], 0
    while i < len(rows):
        if level[i] not in (1, 2):
            i += 1
            continue
        end, words, code = i + 1, 0, False
        while end < len(rows):
            fence = rows[end].lstrip().startswith("```")
            code ^= fence
            if not code and not fence and 0 < level[end] <= level[i]:
                break
            words += 0 if fence or rows[end].lstrip().startswith("|") else len(rows[end].split())
            end += 1
        if words < SHORT_WORDS and rows[i].strip("# \t"):
            out.append(i + 1)
        i = end
    return out


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(p, n) for p, t in zip(pdf["source_path"], pdf["content"]) for n in short_sections(t)], columns=["file_path", "line"])


def lint(docs: DataFrame) -> DataFrame:
    """``source_path, severity, kind, line``: leftover markers, unfilled anchors, links to documents that are not there,
    short sections, and pages of services and controllers that say nothing of algorithms (line null)."""
    docs = docs.select("source_path", "content")
    t = lines(docs.withColumnRenamed("source_path", "file_path"))
    todo = t.where(F.col("text").rlike("TODO|TBD|FIXME|XXX") & ~F.col("text").rlike(r"^\s*```")).select("file_path", F.lit("RED").alias("severity"), F.lit("residual_todo").alias("kind"), "line")
    anchor = t.where(F.col("text").rlike(r"<!-- [A-Z]+:.*-->")).select("file_path", F.lit("RED").alias("severity"), F.lit("unfilled_anchor").alias("kind"), "line")
    links = t.select("file_path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\]\((?!https?:|#|mailto:)([^)#\s]+\.md)"), F.lit(1))).alias("to"))
    links = links.withColumn("target", F.concat(F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1), F.regexp_replace("to", r"^\./", "")))
    broken = links.join(docs.select(F.col("source_path").alias("target")), "target", "left_anti").select("file_path", F.lit("RED").alias("severity"), F.lit("broken_link").alias("kind"), "line")
    short = docs.mapInPandas(_short, "file_path string, line long").select("file_path", F.lit("YELLOW").alias("severity"), F.lit("short_section").alias("kind"), "line")
    low = F.lower("content")
    name = F.lower(F.regexp_replace(F.substring_index("source_path", "/", -1), r"\.[^.]*$", ""))
    bare = docs.where((name.contains("service") | name.contains("controller")) & ~low.contains("§4") & ~low.contains("section 4") & ~low.contains("algorithm"))
    bare = bare.select(F.col("source_path").alias("file_path"), F.lit("YELLOW").alias("severity"), F.lit("missing_section").alias("kind"), F.lit(None).cast("long").alias("line"))
    return todo.unionByName(anchor).unionByName(broken).unionByName(short).unionByName(bare).withColumnRenamed("file_path", "source_path")


def resolve(calls: DataFrame, symbols: DataFrame, named: DataFrame, imports: DataFrame, packages: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """``call_id, target_id, tier, confidence``: the first tier that has a candidate wins; within it candidates of
    matching arity first, then the least id.

    ``calls``: call_id, file, name, n_args and, for calls on an object, receiver. ``symbols``: id, file, name,
    is_exported, required, params and, for members, owner. ``named``: file, name, source_file, source_name.
    ``imports``: file, imported. ``packages``: file, package. ``fields``: file, field, type. In C# files the type of a
    field (without its I) and then a receiver that is a class come first: the symbol must belong to that type or lie in
    a file named after it. A null n_args fits any symbol.

    Symbols that a call could not tell apart (same place, name and arity) are one candidate, the least of them. What a file
    sees by itself and by its imports is listed per file and name, packages and the whole graph per name, and a call
    meets each list once, so no call is paired with all symbols of its name.
    """
    owner = F.col("owner") if "owner" in symbols.columns else F.lit(None).cast("string")
    arity = [F.coalesce("required", F.lit(0)).alias("lo"), F.coalesce("params", F.lit(1 << 30)).alias("hi")]
    s = symbols.select(F.col("id").alias("target_id"), F.col("file").alias("s_file"), F.col("name").alias("s_name"), "is_exported", *arity, owner.alias("s_owner"))
    c = calls.select("call_id", "file", "name", "n_args", (F.col("receiver") if "receiver" in calls.columns else F.lit(None).cast("string")).alias("receiver"))

    def rank(name: str) -> Column:
        return F.lit([t for t, _ in TIERS].index(name)).alias("k")

    def candidate(k: Column, lo: Column, hi: Column, target: Column) -> Column:
        fits = F.col("n_args").isNull() | F.col("n_args").between(lo, hi)
        return F.struct(k.alias("k"), F.when(fits, 0).otherwise(1).alias("m"), target.alias("target_id"))

    def listed(df: DataFrame, *keys: str) -> DataFrame:
        least = df.repartition(*keys).groupBy(*keys, "k", "lo", "hi").agg(F.min("target_id").alias("target_id"))
        return least.groupBy(*keys).agg(F.collect_list(F.struct("k", "lo", "hi", "target_id")).alias("listed"))

    best_listed = F.array_min(F.transform("listed", lambda x: candidate(x["k"], x["lo"], x["hi"], x["target_id"])))

    def tier(df: DataFrame, name: str) -> DataFrame:
        return df.select("call_id", candidate(rank(name), F.col("lo"), F.col("hi"), F.col("target_id")).alias("b"))

    of_type = F.coalesce(F.col("s_owner").contains(F.col("type")), F.lit(False)) | F.col("s_file").contains(F.col("type"))
    on = c.where(F.col("receiver").isNotNull() & F.col("file").endswith(".cs"))
    found = []
    if fields is not None:
        f = fields.select(F.col("file").alias("f_file"), F.col("field").alias("f_field"), F.regexp_replace("type", "^I(?=[A-Z])", "").alias("type"))
        typed = on.join(f, (F.col("file") == F.col("f_file")) & (F.col("receiver") == F.col("f_field")))
        found.append(tier(typed.join(s, F.col("name") == F.col("s_name")).where(of_type), "field_type"))
    classes = symbols.where("kind = 'type'").select(F.col("name").alias("type")).distinct() if "kind" in symbols.columns else None
    if classes is not None:
        static = on.join(classes, F.col("receiver") == F.col("type")).join(s, F.col("name") == F.col("s_name")).where(of_type)
        found.append(tier(static, "static_class"))

    exported = s.where("is_exported")
    rest = ["lo", "hi", "target_id"]
    same = s.select(F.col("s_file").alias("file"), F.col("s_name").alias("name"), rank("same_file"), *rest)
    by_name = named.join(s, (F.col("source_file") == F.col("s_file")) & (F.col("source_name") == F.col("s_name"))).select("file", "name", rank("named_import"), *rest)
    scoped = imports.join(exported, F.col("imported") == F.col("s_file")).select("file", F.col("s_name").alias("name"), rank("import_scoped"), *rest)
    near = c.select("call_id", "file", "name", "n_args").join(listed(same.unionByName(by_name).unionByName(scoped), "file", "name"), ["file", "name"], "left")
    near = near.select("call_id", "file", "name", "n_args", best_listed.alias("near"))

    # a package holds the file of its own name and what lies in a folder whose path has the package's as a run of whole parts
    known = packages.select("package").where("package is not null").distinct()
    last = F.substring_index("s_file", "/", -1)
    placed = exported.withColumn("folder", F.when(F.instr("s_file", "/") > 0, F.substring(F.col("s_file"), F.lit(1), F.length("s_file") - F.length(last) - 1)))
    runs = placed.select("folder").where("folder is not null").distinct().withColumn("parts", F.split("folder", "/"))
    runs = runs.withColumn("first", F.explode(F.sequence(F.lit(1), F.size("parts")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts") - F.col("first") + 1)))
    holds = runs.select("folder", F.array_join(F.slice("parts", F.col("first"), F.col("n")), "/").alias("package")).join(known, "package").distinct()
    name = F.col("s_name").alias("name")
    inside = placed.join(holds, "folder").select(F.col("package").alias("scope"), name, rank("package_scoped"), *rest)
    itself = exported.join(known, F.col("s_file") == F.col("package")).select(F.col("package").alias("scope"), name, rank("package_scoped"), *rest)
    anywhere = exported.select(F.lit("").alias("scope"), name, rank("global"), *rest)
    far = listed(inside.unionByName(itself).unionByName(anywhere).withColumn("place", F.col("k")), "place", "scope", "name")
    places = packages.groupBy("file").agg(F.collect_set("package").alias("packages"))
    place = lambda k, scope: F.struct(k.alias("place"), scope.alias("scope"))
    nowhere, own = F.array(place(F.lit(-1), F.lit(""))), F.coalesce("packages", F.array().cast("array<string>"))
    wide = F.concat(F.transform(own, lambda x: place(rank("package_scoped"), x)), F.array(place(rank("global"), F.lit(""))))
    asked = near.join(places, "file", "left").select("call_id", "name", "n_args", "near", F.explode(F.when(F.col("near").isNull(), wide).otherwise(nowhere)).alias("at")).select("call_id", "name", "n_args", "near", "at.*")
    all_ = asked.join(far, ["place", "scope", "name"], "left").select("call_id", F.coalesce("near", best_listed).alias("b")).where("b is not null")
    for more in found:
        all_ = all_.unionByName(more)
    best = all_.groupBy("call_id").agg(F.min("b").alias("b"))
    name, conf = F.element_at(F.array(*[F.lit(t) for t, _ in TIERS]), F.col("b.k") + 1), F.element_at(F.array(*[F.lit(x) for _, x in TIERS]), F.col("b.k") + 1)
    return best.select("call_id", "b.target_id", name.alias("tier"), conf.alias("confidence"))


# extraction: Python by its own grammar, other languages by declarations, with less fidelity

_DECL = {
    "class": re.compile(r"^\s*(?:(?:export|public|private|protected|internal|abstract|final|static|sealed|partial|default)\s+)*(class|interface|struct|enum|trait|record)\s+([A-Za-z_]\w*)([^\n{;]*)"),
    "func": re.compile(r"^\s*(?:(?:export|public|private|protected|internal|static|async|final|override|virtual|default|pub)\s+)*(?:function|func|fn|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)"),
    "method": re.compile(r"^\s+(?:(?:public|private|protected|internal|static|async|final|override|virtual|abstract|synchronized)\s+)*(?:[A-Za-z_][\w<>\[\],.? ]*\s+)?([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:throws [\w, ]+)?(?::\s*[\w<>\[\]| ]+)?\s*\{?\s*$"),
}
_NOT_NAMES = frozenset("if for while switch catch return foreach new throw else do try using lock function await".split())
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|elif|elsif|unless|when|foreach)\b|&&|\|\||\?(?![.?:])|\band\b|\bor\b")


def supertypes(rest: str, lang: str) -> tuple[list[str], list[str]]:
    """(bases, interfaces) that the head of a declaration names behind the type's own name.

    Where the language has no word of its own for interfaces, names like IName are such.
    """
    rest = re.sub(r"\bwhere\b.*$", "", rest)
    while (flat := re.sub(r"<[^<>]*>|\([^()]*\)", "", rest)) != rest:
        rest = flat
    names = lambda text: [n for x in text.split(",") if (n := re.split(r"[.\\]|::", x.strip().split(" ")[0])[-1]) and re.fullmatch(r"\w+", n)]
    if re.search(r"\b(?:extends|implements)\b", rest):
        parts = re.split(r"\b(extends|implements)\b", rest)
        named = dict(zip(parts[1::2], parts[2::2]))
        return names(named.get("extends", "")), names(named.get("implements", ""))
    mark = "<" if lang == "ruby" else ":"
    every = names(rest.split(mark, 1)[1]) if mark in rest else []
    return [n for n in every if not re.match(r"I[A-Z]", n)], [n for n in every if re.match(r"I[A-Z]", n)]


def symbols_of(path: str, content: str, lang: str) -> list[tuple]:
    """(label, name, owner, start, end, parameters, complexity, bases, interfaces) of one file."""
    out: list[tuple] = []
    if lang == "python":
        try:
            tree = ast.parse(content.removeprefix("﻿"))
        except (SyntaxError, ValueError, RecursionError):
            return out

        def visit(node: ast.AST, owner: str | None) -> None:
            for n in ast.iter_child_nodes(node):
                if isinstance(n, ast.ClassDef):
                    bases = [b.id if isinstance(b, ast.Name) else b.attr for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
                    out.append(("Class", n.name, owner, n.lineno, n.end_lineno, None, None, bases, []))
                    visit(n, n.name)
                elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    c = 1 + sum(isinstance(x, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)) for x in ast.walk(n)) + sum(len(x.values) - 1 for x in ast.walk(n) if isinstance(x, ast.BoolOp))
                    args = len(n.args.args) + len(n.args.kwonlyargs) - (1 if owner and n.args.args and n.args.args[0].arg in ("self", "cls") else 0)
                    out.append(("Method" if owner else "Function", n.name, owner, n.lineno, n.end_lineno, args, c, [], []))
                    visit(n, None)
                else:
                    visit(n, owner)

        visit(tree, None)
        return out
    rows = content.splitlines()
    marks: list[list] = []
    owner = None
    for i, line in enumerate(rows, 1):
        if m := _DECL["class"].match(line):
            owner = m[2]
            marks.append([{"interface": "Interface", "struct": "Struct", "enum": "Enum", "trait": "Trait"}.get(m[1], "Class"), m[2], None, i, None, *supertypes(m[3], lang)])
        elif (m := _DECL["func"].match(line)) or (owner and (m := _DECL["method"].match(line))):
            if m[1] not in _NOT_NAMES:
                marks.append(["Method" if owner and line[:1] in " \t" else "Function", m[1], owner if line[:1] in " \t" else None, i, len([a for a in m[2].split(",") if a.strip()]), [], []])
    for k, (label, name, own, start, params, bases, interfaces) in enumerate(marks):
        later = [m[3] for m in marks[k + 1 :] if label in ("Method", "Function") or m[0] not in ("Method", "Function")]
        end = (later[0] - 1) if later else len(rows)
        c = 1 + len(_BRANCH.findall("\n".join(rows[start:end]))) if label in ("Method", "Function") else None
        out.append((label, name, own, start, end, params, c, bases, interfaces))
    return out


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["file_path", "language", "label", "name", "owner", "start_line", "end_line", "parameter_count", "complexity", "bases", "interfaces"]
    for pdf in batches:
        rows = [(p, g, *s) for p, c, g in zip(pdf["path"], pdf["content"], pdf["language"]) for s in symbols_of(p, c or "", g)]
        out = pd.DataFrame(rows, columns=cols)
        for c in ("start_line", "end_line", "parameter_count", "complexity"):
            out[c] = out[c].astype("Int64")
        yield out


def extract(files: DataFrame) -> DataFrame:
    """Declarations of the scanned files (``path, content, language``), one row each."""
    return spread(files.select("path", "content", "language")).mapInPandas(
        _extract, "file_path string, language string, label string, name string, owner string, start_line long, end_line long, parameter_count long, complexity long, bases array<string>, interfaces array<string>"
    )


def graph_tables(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and DEFINES, HAS_METHOD, EXTENDS and IMPLEMENTS edges of extracted declarations."""
    sid = F.concat_ws(":", "label", "file_path", "name")
    s = symbols.withColumn("id", sid)
    nodes = s.groupBy("id").agg(F.min(F.struct("label", "name", "file_path", "language", "start_line", "end_line", "parameter_count", "complexity")).alias("r")).select("id", "r.*")
    edge = lambda df, a, b, kind: df.select(F.concat_ws("|", a, F.lit(kind), b).alias("id"), a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("type")).distinct()
    defines = edge(s, F.concat(F.lit("File:"), F.col("file_path")), F.col("id"), "DEFINES")
    types = s.where(~F.col("label").isin("Method", "Function")).select(F.col("id").alias("o_id"), F.col("file_path").alias("o_file"), F.col("name").alias("o_name"))
    own = edge(s.where("owner is not null").join(types, (F.col("file_path") == F.col("o_file")) & (F.col("owner") == F.col("o_name"))), F.col("o_id"), F.col("id"), "HAS_METHOD")
    base = types.groupBy("o_name").agg(F.min("o_id").alias("b_id")).withColumnRenamed("o_name", "b_name")
    up = lambda column, kind: edge(s.select("id", F.explode(column).alias("parent")).join(base, F.col("parent") == F.col("b_name")), F.col("id"), F.col("b_id"), kind)
    return nodes, defines.unionByName(own).unionByName(up("bases", "EXTENDS")).unionByName(up("interfaces", "IMPLEMENTS"))


# execution traces

_METHOD = r"([A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+)"


def parse_trace(text: str) -> list[str]:
    """Methods of a trace in order: a JSON array, JSON lines, or log lines with START and insert marks."""
    text = (text or "").strip()
    if text.startswith("["):
        try:
            return [str(x.get("method", "")) for x in json.loads(text) if isinstance(x, dict)]
        except ValueError:
            pass
    out = []
    for line in text.splitlines():
        if line.strip().startswith("{"):
            try:
                out.append(str(json.loads(line).get("method", "")))
                continue
            except ValueError:
                pass
        if re.search(r"(?:\]| )\s?START\b", line) and (m := re.search(_METHOD, line)) and not m[1].endswith(".cs"):
            out.append(m[1])
        if "===== EF INSERT =====" in line:
            out.append("Database.Insert")
    return out


#: Class endings that a structured log line names.
LOG_CLASSES = ("Service", "Controller", "Repository", "Manager", "Helper", "Provider", "Factory", "Client", "Handler", "Processor")


def log_counts(log: DataFrame) -> DataFrame:
    """``method, n`` of log lines (``text``).

    A word between blanks, bars and colons that begins with a class of a known ending and a method counts; only in
    lines without one, whatever ends in Class.Method before a blank, a bar or an opening bracket.
    """
    known = F.filter(F.split("text", r"[\s|:]"), lambda w: w.rlike(rf"^[A-Z]\w*(?:{'|'.join(LOG_CLASSES)})\.\w"))
    a = F.transform(known, lambda w: F.regexp_extract(w, r"^\w+\.\w+", 0))
    words = F.split("text", r"[\s|(]")
    plain = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.regexp_extract(w, r"[A-Z]\w{2,}\.[A-Z]\w+$", 0))
    b = F.filter(plain, lambda w: w != "")
    return log.select(F.explode(F.when(F.size(a) > 0, a).otherwise(b)).alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def resolve_trace(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``step, method, id``: the last part names the method, the one before hints at the path."""
    p = steps.withColumn("parts", F.split("method", r"\.")).withColumn("name", F.element_at("parts", -1)).withColumn("hint", F.when(F.size("parts") > 1, F.element_at("parts", -2)))
    j = p.join(nodes.where(F.col("label").isin("Method", "Function")).select("id", F.col("name").alias("n_name"), "file_path"), F.col("name") == F.col("n_name"), "left")
    miss = F.when(F.col("hint").isNotNull() & F.col("file_path").contains(F.col("hint")), 0).otherwise(1)
    return j.groupBy("step", "method").agg(F.min(F.struct(miss.alias("m"), "id")).alias("b")).select("step", "method", "b.id")


def import_trace(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, is_traced, trace_call_count`` after adding counts (``id, n``)."""
    c = counts.groupBy("id").agg(F.sum("n").alias("n"))
    old = F.coalesce("trace_call_count", F.lit(0)) if "trace_call_count" in nodes.columns else F.lit(0)
    return nodes.join(c, "id", "left").select("id", (F.coalesce("is_traced", F.lit(False)) | F.col("n").isNotNull()).alias("is_traced"), (old + F.coalesce("n", F.lit(0))).cast("long").alias("trace_call_count"))
