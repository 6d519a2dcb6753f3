"""Secret scans with false positives removed by a random forest [native].

Candidates are runs of token characters, found in the whole text: runs of 16 and more, of 8 and
more with a digit in them, and of 8 and more where an assignment, a colon or a quote after one
stands before them. `=`, `:`, `@` and quotes end a run, so what is assigned is a candidate and the
name beside it its context. Each gets numeric features: its length; its character transitions
(changes of case and between letters and digits, letters that alternate as in words, repeats)
and character shares; the share of it that dictionary words cover; whether it looks like a path
or begins as public key formats do; how it is assigned and quoted; and what the name that it is
assigned to and the other neighbouring words say. A random forest trained on labelled findings
tells secrets from the rest.

The forest is grown here with DataFrame operations only: findings are binned, bagged by
hashed weights, and each level of all trees is one aggregate of label counts by (tree, node,
feature, bin), from which windows choose the best split. The fitted forest is a handful of
rows; for prediction it becomes one column expression per tree, so scoring stays in the JVM
beside the scan, without a shuffle.

Labelled findings (``label`` 1: a secret) are a table with the candidates' columns. Where a
corpus has none, ``example_findings`` makes a seeded set: keys and passwords in public formats and
look-alikes, either in the ways that code, configuration, addresses and prose write them down;
the query of this module is trained on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, without

_RUN = r"[A-Za-z0-9+/_.~!$#%^&*-]"
CANDIDATE = rf"(?<!{_RUN})(?:{_RUN}{{16,}}+|(?={_RUN}{{0,15}}[0-9]){_RUN}{{8,}}+|(?<=[=:][\"'`]|[=:] [\"'`]|[=:] |[=:]){_RUN}{{8,}}+)={{0,2}}"
#: Parts of names beside a candidate that speak of secrets, and those that speak of something else; fixed values.
KEY_WORDS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "pass", "key", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "login")
OTHER_WORDS = ("commit", "sha", "sha1", "sha256", "sha512", "md5", "hash", "checksum", "digest", "revision", "rev", "uuid", "guid", "id", "version", "build", "etag", "integrity", "image", "tag", "ref", "file", "path", "url", "host", "date", "time", "name", "class", "index", "page", "node", "public", "example", "sample", "test", "dummy", "placeholder")
#: Words that a dictionary would cover, by which ordinary identifiers are told from random ones; fixed values.
DICTIONARY = (
    "account", "action", "address", "admin", "agent", "alpha", "and", "app", "archive", "array", "article", "asset", "author", "auth", "backup", "base", "beta", "block", "body", "book", "build", "button", "cache", "call", "card", "cell", "change", "channel", "chapter",
    "class", "client", "cloud", "code", "column", "com", "common", "config", "connect", "content", "control", "core", "count", "create", "custom", "data", "date", "default", "delete", "detail", "device", "dir", "doc", "domain", "draft", "edit", "element", "email",
    "engine", "entry", "env", "error", "event", "example", "export", "factory", "feature", "field", "file", "filter", "final", "find", "font", "footer", "for", "form", "format", "frame", "from", "function", "get", "global", "group", "handler", "hash", "header",
    "height", "help", "here", "home", "host", "http", "https", "icon", "image", "import", "index", "info", "input", "item", "json", "key", "label", "layer", "layout", "level", "lib", "library", "license", "light", "line", "link", "list", "load", "local", "log", "mail",
    "main", "manager", "map", "master", "media", "menu", "message", "method", "mode", "model", "module", "month", "name", "net", "next", "node", "number", "object", "option", "order", "org", "package", "page", "panel", "param", "parent", "part", "password", "path",
    "place", "plugin", "post", "print", "process", "product", "profile", "project", "provider", "public", "query", "read", "record", "release", "render", "replace", "report", "request", "resource", "response", "result", "root", "run", "sample", "script", "search",
    "section", "secret", "select", "server", "service", "session", "set", "setting", "site", "size", "source", "start", "state", "static", "status", "store", "string", "style", "system", "table", "target", "task", "temp", "test", "text", "the", "theme", "time", "title",
    "token", "tool", "type", "update", "user", "value", "version", "view", "web", "width", "window", "with", "word", "world", "www", "year", "your",
)
#: How keys begin in formats that their issuers document; fixed values.
PREFIXES = r"^(AKIA|ASIA|AIza|eyJ|SG\.|gh[pousr]_|github_pat_|glpat-|npm_|pypi-|sk_live_|rk_live_|sk-|xox[abprs]-|ya29\.)"
FEATURES = ("length", "digits", "symbols", "classes", "switches", "alternating", "repeats", "distinct", "vowels", "covered", "slashes", "dots", "parts", "hexadecimal", "prefix", "quoted", "assigned", "userinfo", "mailed", "key_name", "other_name", "key_word", "other_word")
TREES, DEPTH, BINS, LEAST = 16, 6, 16, 4
PARTS = ("token", "start", "before", "after")


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """A row per candidate: df's columns, token, start (characters before it), before and after (up
    to 40 characters either side). Texts are split once by the pattern, so the cost is linear."""
    df = without(df, *PARTS)
    columns = [F.col(f"`{c}`") for c in df.columns]
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumns({"__t": F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))})
    found = found.filter(F.size("__t") > 0).withColumn("__g", F.split(t, CANDIDATE, -1))
    # context reaches over the neighbouring candidates
    gap, run = (lambda i: F.coalesce(F.right(F.get("__g", i), F.lit(40)), F.lit(""))), (lambda i: F.coalesce(F.get("__t", i), F.lit("")))
    rows = found.select(
        *columns,
        F.posexplode(F.transform("__t", lambda x, i: F.struct(x.alias("token"), F.right(F.concat(gap(i - 2), run(i - 2), gap(i - 1), run(i - 1), gap(i)), F.lit(40)).alias("before"), F.left(F.concat(F.left(F.get("__g", i + 1), F.lit(40)), run(i + 1), F.coalesce(F.left(F.get("__g", i + 2), F.lit(40)), F.lit(""))), F.lit(40)).alias("after"), F.length(F.get("__g", i)).alias("gap")))).alias("__i", "__c"),
        F.transform("__t", lambda x, i: F.length(F.get("__g", i)) + F.length(x)).alias("__spans"),
    )
    start = F.aggregate(F.slice("__spans", 1, F.col("__i")), F.lit(0), lambda a, x: a + x) + F.col("__c.gap")
    rows = rows.select(*columns, F.col("__c.token").alias("token"), start.cast("long").alias("start"), F.col("__c.before").alias("before"), F.col("__c.after").alias("after"))
    t = F.col("token")
    return rows.filter(t.rlike("[0-9]") & t.rlike("[A-Za-z]") | t.rlike("[a-z][A-Z]") | F.col("before").rlike(r"[=:]\s?[\"'`]?$") & t.rlike("[A-Za-z0-9]{4}"))


def with_features(found: DataFrame) -> DataFrame:
    """Add FEATURES (int) to rows with token, before and after; nulls count as empty."""
    t, before, after = (F.coalesce(F.col(c), F.lit("")) for c in ("token", "before", "after"))
    low, n = F.lower(t), F.greatest(F.length(t), F.lit(1))
    kept = lambda s, p: F.length(F.regexp_replace(s, p, ""))
    percent = lambda x: F.floor(x * 100 / n).cast("int")
    near = F.lower(F.concat_ws(" ", before, after))
    # the name that the candidate is assigned to, or the word before it
    name = F.lower(F.regexp_extract(before, r"([A-Za-z][A-Za-z0-9_.-]*)[\"'`\])]*\s*(?:=>|:=|=|:|\s)\s*[\"'`]?$", 1))
    name = F.regexp_replace(F.regexp_replace(name, r"^(the|is|was|as|of|to)$", ""), "[_.-]", " ")
    word = lambda x, ws: F.when(x.rlike(rf"(^|[^a-z0-9])({'|'.join(ws)})([^a-z0-9]|$)"), 1).otherwise(0)
    switch = F.length(F.regexp_replace(F.regexp_replace(t, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z]{2})(?=[a-z])", "\u0001"), "[^\u0001]", ""))
    values = {
        "length": F.least(F.length(t), F.lit(200)),
        "digits": percent(kept(t, "[^0-9]")),
        "symbols": percent(kept(t, "[A-Za-z0-9]")),
        "classes": sum((F.when(t.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0)),
        "switches": percent(switch),
        "alternating": percent(F.length(t) - F.length(F.regexp_replace(low, "[bcdfghjklmnpqrstvwxyz]h?[aeiou]", ""))),
        "repeats": percent(kept(low, r"(.)(?!\1)")),
        "distinct": percent(F.size(F.array_distinct(F.split(t, "")))),
        "vowels": percent(kept(low, "[^aeiou]")),
        "covered": percent(F.length(t) - F.length(F.regexp_replace(low, f"({'|'.join(DICTIONARY)})", ""))),
        "slashes": kept(t, "[^/]"),
        "dots": kept(t, "[^.]"),
        "parts": F.size(F.split(t, "[/_.~-]+")),
        "hexadecimal": F.when(low.rlike("^[0-9a-f]+$"), 1).otherwise(0) + F.when(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), 2).otherwise(0),
        "prefix": F.when(t.rlike(PREFIXES), 1).otherwise(0),
        "quoted": F.when(before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), 1).otherwise(0),
        "assigned": F.when(before.rlike("(=|:|=>)\\s*[\"'`]?$"), 1).otherwise(0),
        "userinfo": F.when(before.rlike("//[^/\\s:]*:$") & after.startswith("@"), 1).otherwise(0),
        "mailed": F.when(after.rlike("^@[A-Za-z0-9]") & ~before.rlike("//[^/\\s:]*:$"), 1).otherwise(0),
        "key_name": word(name, KEY_WORDS),
        "other_name": word(name, OTHER_WORDS),
        "key_word": word(near, KEY_WORDS),
        "other_word": word(near, OTHER_WORDS),
    }
    found = without(found, *FEATURES)
    return found.select(*[F.col(f"`{c}`") for c in found.columns], F.inline(F.array(F.struct(*[v.cast("int").alias(k) for k, v in values.items()]))))


def edges(findings: DataFrame) -> dict[str, list[int]]:
    """Bin edges of each feature: its distinct 16-quantiles over the findings."""
    qs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = findings.agg(*[F.percentile(f, qs).alias(f) for f in FEATURES]).first()
    return {f: sorted({int(e) for e in row[f] or []}) for f in FEATURES}


def literal(numbers) -> Column:
    """An array of numbers, as one expression however many they are."""
    return F.expr(f"array({','.join(map(str, numbers))})")


def walk(x: Column, tree: Column, splits: dict[tuple[int, int], tuple], trees: int, depth: int, steps: int) -> Column:
    """Node of ``tree`` that an array of values reaches in ``steps`` steps from the root; a walk stays at
    a node without a split. Splits by (tree, node) lie in literal arrays, a tree after another."""
    size = 2 << depth
    flat = [splits.get((t, n), (-1, 0)) for t in range(trees) for n in range(size)]
    feature, edge = literal(f for f, _ in flat), literal(e for _, e in flat)
    at = lambda a, n: F.get(a, tree * size + n)
    step = lambda n, _: F.when(at(feature, n) < 0, n).otherwise(n * 2 + (F.get(x, at(feature, n)) > at(edge, n)).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1), step) if steps else F.lit(1)


def forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list[dict]:
    """Grow the forest on findings (FEATURES, label 0 or 1; null labels are left out). Returns a dict
    of nodes per tree, from node number (root 1, children 2n and 2n + 1) to (feature, edge) or to
    a leaf's share of secrets. What comes to the driver is a row per node of a level, at most
    trees * 2^depth, however many findings there are. Without findings every tree is empty."""
    spark, scratch = findings.sparkSession, Scratch(findings.sparkSession)
    findings = scratch.keep(findings.filter("label is not null").select(*FEATURES, "label"), "findings")
    cut = edges(findings)
    below = lambda f: F.filter(F.array(*map(F.lit, cut[f])).cast("array<int>"), lambda e: F.col(f) > e)
    bins = F.array(*[F.size(below(f)) for f in FEATURES])
    rows = findings.select(F.col("label").cast("long").alias("label"), bins.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.xxhash64(*FEATURES, "label").alias("h"))
    # bagging: a row's weight in a tree is a hashed draw of 0, 1, 1 or 2
    weight = F.get(F.array(*map(F.lit, (0, 1, 1, 2))), F.pmod(F.xxhash64("h", "tree", F.lit(seed)), F.lit(4)).cast("int"))
    rows = scratch.keep(rows.withColumn("w", weight.cast("long")).filter("w > 0"), "rows")
    grown: list[dict] = [{} for _ in range(trees)]
    splits: dict[tuple[int, int], tuple[int, int]] = {}
    for level in range(depth + 1):
        node = walk(F.col("x"), F.col("tree"), splits, trees, depth, level)
        here = rows.withColumn("node", node).filter(F.col("node") >= 1 << level)  # the rest are at a leaf
        cells = here.select("tree", "node", "w", "label", F.posexplode("x").alias("f", "b")).groupBy("tree", "node", "f", "b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("y"))
        one = Window.partitionBy("tree", "node", "f")
        run = one.orderBy("b")
        cells = cells.withColumns({"ln": F.sum("n").over(run), "ly": F.sum("y").over(run), "tn": F.sum("n").over(one), "ty": F.sum("y").over(one)})
        rn, ry = F.col("tn") - F.col("ln"), F.col("ty") - F.col("ly")
        impurity = lambda y, n: F.when(n > 0, 2 * y * (n - y) / n)
        tried = F.pmod(F.xxhash64("tree", "node", "f", F.lit(seed)), F.lit(2)) == 0  # a hashed half of the features at each node
        gain = F.when(tried & (rn >= LEAST) & (F.col("ln") >= LEAST), impurity(F.col("ty"), F.col("tn")) - impurity(F.col("ly"), F.col("ln")) - impurity(ry, rn))
        best = F.max(F.when(gain > 1e-9, F.struct(gain.alias("gain"), "f", "b")))
        for r in cells.groupBy("tree", "node").agg(F.max("tn").alias("tn"), F.max("ty").alias("ty"), best.alias("best")).collect():
            if level < depth and r.best:
                f = FEATURES[r.best.f]
                grown[r.tree][r.node] = (f, cut[f][r.best.b])
                splits[r.tree, r.node] = (r.best.f, r.best.b)
            else:
                grown[r.tree][r.node] = float(r.ty) / float(r.tn) if r.tn else 0.0
        if not any(n >= 1 << level for _, n in splits):
            break
    return grown


def probability(grown: list[dict], depth: int = DEPTH) -> Column:
    """Mean over trees of the share of secrets at a row's leaf."""
    splits = {(t, n): (FEATURES.index(x[0]), x[1]) for t, nodes in enumerate(grown) for n, x in nodes.items() if isinstance(x, tuple)}
    share = literal(f"{0.0 if isinstance(x := t.get(n, 0.0), tuple) else float(x)!r}D" for t in grown for n in range(2 << depth))
    leaf = lambda t: F.get(share, t * (2 << depth) + walk(F.array(*FEATURES), t, splits, len(grown), depth, depth))
    return F.aggregate(literal(range(len(grown))), F.lit(0.0), lambda total, t: total + leaf(t), lambda total: total / len(grown))


#: What names of secrets begin with, and names of other things; values that stand where a secret will be; fixed values.
_OWNERS = ("", "", "", "db_", "aws_secret_", "github_", "client_", "my", "app.", "x-api-", "smtp_", "user_")
_OTHERS = ("commit", "sha", "revision", "checksum", "md5", "sha256", "digest", "etag", "uuid", "build_id", "version", "image", "integrity", "ref", "tag", "file", "path", "url", "host", "class", "name", "date", "index", "page_id", "node", "order_id", "content_hash", "public_id")
_BLANKS = ("your_api_key_here", "your-password-here", "xxxxxxxxxxxxxxxx", "REPLACE_ME_1234", "example_token_123", "changeme123", "TODO_insert_key_1", "0000000000000000", "************", "process.env.API_KEY2", "config.getToken2", "env.DB_PASSWORD_1", "settings.SECRET_KEY", "secrets.DEPLOY_TOKEN2", "/run/secrets/db_password", "tokenProvider2", "get_auth_token_v2", "//auth.example.org/oauth2/token")


def example_findings(spark: SparkSession, n: int = 8000, seed: int = 0) -> DataFrame:
    """``n`` labelled findings (token, before, after, label) from hashed draws. Half are secrets: keys
    and tokens in publicly documented formats, random strings and passwords. The rest are hashes,
    identifiers, versions, paths, addresses, names, dates and numbers, and what stands in for a
    secret. Either come in assignments, quoted or not, mappings, options, headers, queries,
    addresses and prose; kinds, names and ways are drawn independently, but where a bare string
    of a kind would tell nothing it gets a name."""
    at = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m)).cast("int")
    pick = lambda k, xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), at(k, len(xs)))
    # inline() of one struct: what is picked from below is made once
    once = lambda rows, *keep, **made: rows.select(*keep, F.inline(F.array(F.struct(*[x.alias(k) for k, x in made.items()]))))
    scratch, rows = Scratch(spark), spark.range(n).withColumn("label", F.pmod("id", F.lit(2)).cast("int"))
    hashes = {f"draw_{k}": F.sha2(F.concat_ws(":", F.col("id"), F.lit(seed), F.lit(k)), 256) for k in "abcdpq"}
    rows = once(rows, "id", "label", **hashes, **{f"word_{k}": F.get(F.split(F.lit(" ".join(DICTIONARY)), " "), at(str(k), len(DICTIONARY))) for k in range(1, 16)})
    draw, word = (lambda k: F.col(f"draw_{k}")), (lambda k: F.col(f"word_{k}"))
    rows = once(rows, "*", base64=F.regexp_replace(F.base64(F.unhex(F.concat(draw("a"), draw("b")))), "[\r\n=]", ""), digits=F.lpad(F.conv(F.left(draw("p"), F.lit(15)), 16, 10), 18, "7"))
    rows = once(rows, "*", plain=F.regexp_replace("base64", "[^A-Za-z0-9]", ""))
    base64, plain = F.col("base64"), F.col("plain")
    number = lambda k, m: F.substr("digits", F.lit(18 - m - int(k) % 5), F.lit(m))
    cat = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    left, right = (lambda x, m: F.left(x, F.lit(m) if isinstance(m, int) else m)), (lambda x, m: F.right(x, F.lit(m) if isinstance(m, int) else m))
    coined = cat(*[pick(k, ("ba", "ter", "lo", "min", "sa", "ren", "vi", "dor", "ke", "tan", "el", "ung", "os", "ri")) for k in ("c1", "c2", "c3")])
    hexed = left(draw("c"), pick("n", (32, 40, 64)))
    typed = F.call_function("translate", left(draw("p"), pick("m", (8, 9, 10, 12, 14, 16))), F.lit("0123456789abcdef"), pick("s", ("aQ7$mZ2kR!x9Tb_G", "w4Ne#h8Vq.5Ly&3C", "k2j7d9s4t8b3m6f5", "pX%r9c*U3vW^z6tA", "HgK5nE2yM8!uD7iS")))
    strong = {
        "access": cat(pick("1", ("AKIA", "ASIA")), left(F.upper(plain), 16)), "prefixed": cat(pick("2", ("ghp_", "gho_", "npm_")), left(plain, 36)), "dashed": cat(pick("3", ("glpat-", "sk-", "pypi-")), left(plain, pick("n", (20, 24, 40)))),
        "live": cat(pick("4", ("sk_live_", "rk_live_")), left(plain, 24)), "chat": cat(pick("5", ("xoxb-", "xoxp-")), number("6", 11), "-", number("7", 11), "-", right(plain, 24)), "maps": cat("AIza", left(plain, 35)), "post": cat("SG.", left(plain, 22), ".", right(plain, 43)),
        "signed": cat("eyJ", left(plain, 30), ".eyJ", left(F.reverse(plain), 40), ".", right(plain, 30)),
    }
    weak = {"hex": hexed, "base64": cat(left(base64, pick("n", (24, 40, 43, 64))), pick("8", ("", "", "=", "=="))), "letters": left(plain, pick("n", (16, 20, 24, 32, 40))), "typed": typed, "pin": left("digits", pick("m", (8, 10, 12, 14))), "small": F.call_function("translate", left(draw("q"), pick("m", (10, 12, 16, 20))), F.lit("0123456789abcdef"), F.lit("kqzvxwjpbmtrnsdf")), "phrase": cat(F.initcap(word("1")), number("9", 4), pick("m", ("!", "$", "#x", "_Q", "&7"))), "hexed": F.upper(hexed)}
    nothing = {
        "hex": hexed, "sha": left(draw("d"), 40), "uuid": F.regexp_replace(left(draw("d"), 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), "sri": cat(pick("1", ("sha256-", "sha384-", "sha512-")), left(base64, pick("n", (43, 64)))),
        "version": cat(word("1"), "-", number("2", 1), ".", number("3", 2), ".", number("4", 1), pick("5", ("", "-beta.2", ".tar.gz", "-rc1", ".min.js"))), "file": cat(word("1"), "_", word("2"), number("3", 3), pick("4", (".png", ".csv", ".html", ".py"))),
        "path": cat("/", word("1"), "/", word("2"), number("3", 1), "/", word("4"), pick("5", ("", "/index.html", ".conf"))), "address": cat("//", word("1"), ".", word("2"), number("3", 1), ".com/", word("4"), "/", number("5", 4)), "host": cat(word("1"), number("2", 2), ".", word("3"), ".", pick("4", ("org", "com", "net"))),
        "camel": cat(word("1"), F.initcap(word("2")), F.initcap(word("3")), pick("4", ("", "2", "V3"))), "snake": cat(word("1"), "_", word("2"), "_", word("3"), pick("4", ("_1", "_v2", "2"))), "upper": F.upper(cat(word("1"), "_", word("2"), "_", number("3", 2))),
        "date": cat("2", number("1", 3), "-0", number("2", 1), "-1", number("3", 1), pick("4", ("", "T12", "-", ".log"))), "number": number("5", 12), "phone": cat(number("1", 3), "-", number("2", 3), "-", number("3", 4)), "doi": cat("10.", number("1", 4), "/", word("2"), ".", number("3", 5)), "prose": cat(word("1"), number("2", 2), "-", word("3"), "-", word("4")),
        "person": cat(word("1"), pick("2", (".", "_", "-", "")), pick("3", (word("2"), number("4", 2), number("4", 4)))), "coined": cat(coined, pick("2", (".", "_", "-", "")), number("4", 2)),
    }
    choose = lambda k, group, *names: pick(k, [F.col(f"{g}.{x}") for g in group.split() for x in (names or {"strong": strong, "weak": weak, "nothing": nothing}[g])])
    key_name = cat(pick("o", _OWNERS), pick("k", [w for w in KEY_WORDS if w not in ("auth", "private", "access", "bearer", "authorization", "login")]))
    key_name = pick("u", (key_name, key_name, F.upper(key_name), F.initcap(key_name), F.regexp_replace(key_name, "_", "-")))
    other_name = pick("x", (pick("y", _OTHERS), pick("y", _OTHERS), F.upper(pick("y", _OTHERS)), cat(word("11"), "_", pick("y", _OTHERS)), word("11")))
    # ways: what stands before a name, between it and the value, and after
    way = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
    quoted = [way(a, b + q, q + c) for q in "\"'" for a, b, c in ((" ", "=", "\n"), (" ", " = ", ";"), ("let ", " = ", ";"), ("", ": ", ","), ("self.", "=", ")"), (" ", " => ", ","))]
    quoted += [way('"', '": "', '",'), way("{'", "': '", "'}"), way('["', '"] = "', '"'), way("<", '="', '"/>')]
    bare = [way("export ", "=", "\n"), way("", "=", "\n"), way("\n", "=", " "), way("  ", ": ", "\n"), way("--", " ", " "), way("--", "=", " "), way("?", "=", "&page=1"), way("&", "=", " "), way("set ", " ", "\n"), way("the ", " is ", " and"), way("with ", " ", ", "), way("// ", ": ", "\n")]
    how = pick("w", quoted + bare + bare)
    named = lambda name: F.struct(cat(word("12"), " ", F.col("how.a"), F.col(name), F.col("how.b")).alias("b"), cat(F.col("how.c"), word("13")).alias("a"))
    alone = F.struct(cat(word("12"), pick("13", (" ", " ", "\n", ", ", " ("))).alias("b"), cat(pick("14", (" ", ".", ",", "\n", ") ")), word("15")).alias("a"))
    header = F.struct(cat(word("12"), pick("16", ('"Authorization: Bearer ', "Authorization: token ", "authorization: bearer "))).alias("b"), pick("17", ('"', "\n", "' ")).alias("a"))
    login = F.struct(cat(word("12"), pick("16", (" https://", " postgres://", " ftp://", '"mongodb://')), word("13"), ":").alias("b"), cat("@", word("14"), pick("17", (".com/", ".org ", "/db"))).alias("a"))
    local = F.struct(cat(word("12"), pick("13", (" ", " <", "\n", ", ", "mailto:"))).alias("b"), cat("@", word("14"), pick("17", (".com", ".org>", ".net,"))).alias("a"))
    mail = F.struct(cat(word("12"), " ", word("13"), ".", word("14"), "@").alias("b"), cat(pick("17", (" ", ".", ",", ">")), word("15")).alias("a"))
    kind = at("kind", 20)
    for name, group in (("strong", strong), ("weak", weak), ("nothing", nothing)):
        rows = once(rows, "*", **{name: F.struct(*[v.alias(k) for k, v in group.items()])})
    rows = scratch.keep(rows, "made")  # all of it in one stage would be too much code to compile
    rows = once(rows, "*", key_name=key_name, other_name=other_name, how=how)
    secret = F.when(kind < 4, F.struct(choose("v", "strong").alias("t"), alone.alias("c"))).when(kind < 7, F.struct(choose("v", "strong").alias("t"), named("key_name").alias("c")))
    secret = secret.when(kind < 9, F.struct(choose("v", "strong weak").alias("t"), header.alias("c"))).when(kind < 11, F.struct(choose("v", "weak").alias("t"), login.alias("c"))).otherwise(F.struct(choose("v", "weak").alias("t"), named("key_name").alias("c")))
    other = F.when(kind < 6, F.struct(choose("v", "nothing").alias("t"), alone.alias("c"))).when(kind < 7, F.struct(F.col("nothing.host").alias("t"), mail.alias("c"))).when(kind < 8, F.struct(choose("v", "nothing", "person", "coined", "file", "snake", "camel").alias("t"), local.alias("c"))).when(kind < 11, F.struct(pick("v", _BLANKS).alias("t"), named("key_name").alias("c")))
    other = other.when(kind < 12, F.struct(choose("v", "nothing", "path", "camel", "snake", "upper", "file", "address").alias("t"), named("key_name").alias("c"))).otherwise(F.struct(choose("v", "nothing").alias("t"), named("other_name").alias("c")))
    rows = rows.withColumn("x", F.when(F.col("label") == 1, secret).otherwise(other))
    return scratch.keep(rows.select(F.col("x.t").alias("token"), F.right("x.c.b", F.lit(40)).alias("before"), F.left("x.c.a", F.lit(40)).alias("after"), "label"), "examples")


def scan(df: DataFrame, labelled: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row per candidate of ``df``: its columns, PARTS, FEATURES, score, is_secret.

    ``labelled`` holds findings (token, before, after, label) that the forest is trained on. Null
    and empty texts have no candidates, an empty table has no rows; long texts are searched whole;
    repeated rows and equal candidates are each reported, with equal scores; a score on the
    threshold is a secret; without labelled findings every score is 0. Input columns that the
    scan adds are replaced.
    """
    return scored(df, forest(with_features(labelled)), text, threshold)


def scored(df: DataFrame, grown: list[dict], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``scan`` with a forest that is grown already."""
    found = with_features(candidates(without(df, "score", "is_secret"), text))
    return found.withColumn("score", F.round(probability(grown), 6)).withColumn("is_secret", F.col("score") >= threshold)


_standard: list[list[dict]] = []


def standard(spark: SparkSession) -> list[dict]:
    """The forest of ``example_findings``: the same numbers in every session, so grown once a process."""
    if not _standard:
        _standard.append(forest(with_features(example_findings(spark))))
    return _standard[0]


def op1(spark, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), standard(spark))
    return found.select("doc_id", "start", F.length("token").alias("length"), F.sha2("token", 256).alias("fingerprint"), "score", "is_secret")
