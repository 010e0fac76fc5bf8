"""Column functions shared by the query language, ranking and analytics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
#: Path fragments and directories of minified, generated and third-party files.
LIGHT_FRAGMENTS = (".min.js", ".min.css", ".min.map", "-min.js", "-min.css", "-vsdoc.js", ".vsdoc.js", ".designer.cs", ".g.cs", ".g.i.cs", "scripts/jquery", "scripts/knockout", "scripts/kendo", "scripts/telerik", "scripts/angular", "scripts/bootstrap", "scripts/modernizr", "scripts/moment", "scripts/history")
LIGHT_FOLDERS = ("packages", "node_modules", "bower_components", "vendor", "obj", "bin")
#: Labels that rank higher and lower.
HEAVY_LABELS = ("Class", "Method", "Function", "Constructor", "Interface", "Controller", "ControllerAction", "Service", "Repository", "Route")
LIGHT_LABELS = ("ScriptFile", "Import", "ExternalService", "UiComponent")


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def path_weight(path: Column) -> Column:
    """0.1 for minified, generated and third-party paths, else 1.0."""
    low = F.lower(F.coalesce(path, F.lit("")))
    fragments = "|".join(f.replace(".", r"\.") for f in LIGHT_FRAGMENTS)
    return F.when(low.rlike(rf"{fragments}|(?:^|[/\\])(?:{'|'.join(LIGHT_FOLDERS)})(?:[/\\]|$)|wwwroot[/\\]lib[/\\]"), 0.1).otherwise(1.0)


def label_weight(label: Column) -> Column:
    return F.when(label.isin(*HEAVY_LABELS), 1.5).when(label.isin(*LIGHT_LABELS), 0.4).otherwise(1.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for vectors of different lengths or without a norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def module_of(path: Column) -> Column:
    """The first path segment, or the first two if the second is no file name."""
    p = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.when((F.size(p) > 1) & ~p[1].contains("."), F.concat_ws("/", p[0], p[1])).otherwise(p[0])


def complexity_severity(c: Column) -> Column:
    return F.when(c <= 5, "low").when(c <= 10, "moderate").when(c <= 20, "high").otherwise("critical")


def cycle_severity(n: Column) -> Column:
    return F.when(n <= 3, "low").when(n <= 6, "medium").otherwise("high")


def risk(direct: Column, transitive: Column, processes: Column) -> Column:
    return F.when((processes >= 2) | (transitive >= 20), "high").when((processes >= 1) | (transitive >= 5) | (direct >= 3), "medium").when(direct > 0, "low").otherwise("none")


def layer_of(label: Column, path: Column) -> Column:
    """Presentation, Business or Data by label, else by path; null if neither tells."""
    low = F.lower(F.coalesce(path, F.lit("")))
    by_path = F.when(low.contains("controller") | low.contains("/views/"), "Presentation").when(low.rlike("service|/bal/|/bll/"), "Business").when(low.rlike("repository|/dal/|entities|dbcontext"), "Data")
    return F.when(label.isin("Controller", "ControllerAction", "ApiEndpoint", "View"), "Presentation").when(label == "Service", "Business").when(label.isin("Repository", "DbContext", "DbEntity"), "Data").otherwise(by_path)


def layer_order(layer: Column) -> Column:
    return F.when(layer == "Presentation", 0).when(layer == "Business", 1).when(layer == "Data", 2)


def mermaid_escape(text: Column) -> Column:
    """Entities for characters that end a label; the ampersand comes first."""
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"), ("(", "&#40;"), (")", "&#41;"), ("{", "&#123;"), ("}", "&#125;"), ("|", "&#124;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def next_route(path: Column) -> Column:
    """The route of a file below app/: [id] becomes :id, (group) drops out."""
    p = F.regexp_replace(path, r"\\", "/")
    tail = F.regexp_replace(F.regexp_replace(p, r"^(?:app/|.*?/app/)", ""), r"(?:^|/)[^/]*$", "")
    parts = F.filter(F.split(tail, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.regexp_replace(s, r"^\[(.*)\]$", ":$1")), "/"))


def normalize_route(route: Column) -> Column:
    r = F.regexp_replace(route, "/+$", "")
    return F.when(F.coalesce(r, F.lit("")) == "", "/").when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r))


def as_text(c: Column, kind: str) -> Column:
    """The display form of a value: whole numbers without fraction, null as the word."""
    s = F.regexp_replace(c.cast("string"), r"\.0$", "") if kind in ("double", "float") else c.cast("string")
    return F.coalesce(s, F.lit("null"))


def bytes_head(text: Column, n: int) -> Column:
    """The longest beginning of a text that takes at most n bytes."""
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, n), "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))


#: What paths tell of a framework, as (test of the lower-case path, multiplier, reason), first match first.
FRAMEWORKS = (
    (r"(?:^|/)app/(?:.*/)?page\.", 2.0, "Next.js App Router page"), (r"(?:^|/)app/(?:.*/)?layout\.", 1.8, "Next.js App Router layout"), (r"(?:^|/)app/(?:.*/)?route\.", 2.0, "Next.js App Router API route"), (r"(?:^|/)app/(?:.*/)?(?:loading|error)\.", 1.3, "Next.js App Router boundary"),
    (r"(?:^|/)pages/(?:.*/)?_(?:app|document)\.", 1.5, "Next.js Pages Router shell"), (r"(?:^|/)pages/(?:.*/)?[^/]*\.[jt]sx?$", 1.8, "Next.js Pages Router page"), (r"(?:^|/)(?:routes|controllers)/.*\.(?:[cm]?js|tsx?|jsx)$", 1.5, "Express/Node.js route or controller"), (r"(?:^|/)middlewares?/.*\.(?:[cm]?js|tsx?|jsx)$", 1.3, "Express/Node.js middleware"),
    (r"(?:^|/)(?:views|urls)\.py$", 1.8, "Django view/URL configuration"), (r"(?:^|/)models\.py$", 1.5, "Django model definition"), (r"(?:^|/)serializers\.py$", 1.3, "Django REST serializer"),
)


def framework_of(path: Column) -> Column:
    """``multiplier, reason`` of the framework that a path shows, or null."""
    low, out = F.lower(F.regexp_replace(path, r"\\", "/")), F.lit(None).cast("struct<multiplier: double, reason: string>")
    for pattern, weight, reason in reversed(FRAMEWORKS):
        out = F.when(low.rlike(pattern), F.struct(F.lit(weight).alias("multiplier"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


#: Names of entry points, prefixes of handlers and of helpers, with their scores.
ENTRY_SCORES = {"main": 1.0, "init": 0.8, "bootstrap": 0.9, "start": 0.85, "run": 0.8, "setup": 0.7, "configure": 0.7, "register": 0.6, "mount": 0.6, "listen": 0.7, "serve": 0.7, "execute": 0.6, "launch": 0.8, "create_app": 0.9, "create_server": 0.9}
HANDLER_SCORES = {"handle": 0.7, "on_": 0.65, "on": 0.5, "process": 0.6, "dispatch": 0.6, "route": 0.6, "middleware": 0.5}
HELPER_SCORES = {"is": 0.1, "has": 0.1, "get": 0.15, "set": 0.15, "to": 0.1, "from": 0.15, "parse": 0.15, "format": 0.1, "validate": 0.15, "normalize": 0.1, "convert": 0.1, "transform": 0.1}


def name_score(name: Column) -> Column:
    """How much a name is that of an entry point: exact names, then prefixes before a capital or an underscore; or null."""
    low, out = F.lower(name), F.lit(None).cast("double")
    for scores in (HELPER_SCORES, HANDLER_SCORES):
        for prefix, score in reversed(scores.items()):
            rest = F.substring(name, F.lit(len(prefix) + 1), F.length(name))
            out = F.when(low.startswith(prefix) & rest.rlike(r"^(?:_|\p{Lu})"), F.lit(score)).otherwise(out)
    for word, score in ENTRY_SCORES.items():
        out = F.when(low == word, F.lit(score)).otherwise(out)
    return out
