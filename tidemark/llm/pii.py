r"""Personal data: base patterns and bootstrapped contextual extraction.

Base entities are e-mail addresses, IP addresses, payment cards and phone
numbers by pattern and check.  With quoted or bare values assigned to a
credential word (kind ``secret``) they seed a bootstrap over *instances*: base
entities, and the other runs of tokens with a digit or ``@``, 6 to 128
characters long.  The *patterns* of an instance are lexical: the two words
before it, and the word before with the word after, each with the coarse class
of the value (holding ``@``, letters and digits, or no letters), but not its
shape, so that values of forms never seen before can fit.

Patterns and values make a bipartite graph, scored round by round: a pattern's
confidence in a kind is the smoothed share of its distinct values believed to be
of the kind, and a value is believed as much as the best of its patterns.
Instances in patterns with high confidence and support that overlap no base
entity are added as spans.

All of it is DataFrame expressions; positions are code points.  Every regular
expression starts only where a run of its characters starts (or where its last
match ended), so that a text is scanned in time in proportion to its length,
unbroken ones too, and positions come from running sums over blocks of matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import Scratch

KINDS = ("email", "ip", "card", "phone")
FOUND_KINDS = (*KINDS, "secret")
ROUNDS = 3
CONFIDENCE = 0.8
SUPPORT = 3
LEAST_LENGTH, MOST_LENGTH = 6, 128
LEAST_SECRET = 16
BLOCK = 64

# The base patterns, possessive where nothing can be given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
_TOKEN = r"[^\s0-9@]*+[0-9@][^\s]*+"
_RUN = rf"(?<!\S){_TOKEN}(?: {_TOKEN})*+"
# Words that credentials are assigned to.
_ASSIGNED = r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?$"

_KEY = ["doc_id", "text_hash"]
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
_INSTANCE = "array<struct<start:int,end:int,kind:string,value:string,left:string,right:string>>"


def _digits(x) -> F.Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x) -> F.Column:
    digits = _digits(x)
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str, x) -> F.Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part):
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) <= 3) & (F.coalesce(F.try_to_number(F.lpad(bare, 3, "0"), F.lit("999")), F.lit(999)) <= 255)

        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        return _luhn(x)
    return F.length(_digits(x)).between(10, 15)


def _let(value, body) -> F.Column:
    """``body(value)`` with the value computed once, also where the body is a lambda over other elements."""
    return F.get(F.transform(F.array(value), body), 0)


def _running_sums(lengths) -> F.Column:
    """The sum of the lengths before each; by blocks, so that no array is copied for every element."""
    n = F.size(lengths)

    def total(first, many):
        return F.when(many > 0, F.aggregate(F.sequence(first, first + many - 1), F.lit(0), lambda s, j: s + F.get(lengths, j))).otherwise(0)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(b * BLOCK, F.least(F.lit(BLOCK), n - b * BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    before = F.aggregate(blocks, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def each(offsets):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(offsets, F.floor(i / BLOCK).cast("int")) + total(i - i % BLOCK, i % BLOCK))

    return F.when(n > 0, _let(before, each)).otherwise(F.expr("cast(array() as array<int>)"))


def _matched(df: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """``df`` plus ``name``: array<struct(start, end, value, left, right)> of the leftmost non-overlapping matches in ``text``.

    left and right are the ends of the text between this match and its neighbours.
    """
    asked = F.col("text").rlike(needs)
    empty = F.expr("cast(array() as array<string>)")
    df = df.withColumn("_values", F.when(asked, F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).otherwise(empty))
    df = df.withColumn("_gaps", F.when(F.size("_values") > 0, F.split("text", pattern, -1)).otherwise(empty))

    def placed(gaps):
        def with_starts(starts):
            def match(v, i):
                start = F.get(starts, i) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), F.right(F.get(gaps, i), F.lit(48)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(24)).alias("right"))

            return F.transform("_values", match)

        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size("_values")), "_values", lambda g, v: F.length(g) + F.length(v))
        return _let(_let(lengths, _running_sums), with_starts)

    return df.withColumn(name, _let(F.col("_gaps"), placed)).drop("_values", "_gaps")


def marked(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, text_hash, text)`` without text, plus ``base`` and ``runs``: base entities and token runs, with contexts."""
    df = rows
    for kind in KINDS:
        df = _matched(df, f"_{kind}", PATTERNS[kind], _NEEDS[kind])

    def entity(kind: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right"))

    def valid(kind: str):
        return lambda m: _valid(kind, m["value"])

    found = [F.transform(F.filter(f"_{kind}", valid(kind)), entity(kind)) for kind in KINDS]
    df = _matched(df, "runs", _RUN, "[0-9@]")
    short = F.filter("runs", lambda m: F.length(m["value"]).between(LEAST_LENGTH, 2 * MOST_LENGTH))
    return df.select(*_KEY, F.array_sort(F.concat(*found)).alias("base"), short.alias("runs"))


def _cores(runs: DataFrame) -> DataFrame:
    """Runs without what is glued to their ends: quotes, brackets, closing punctuation, and a label up to ``=`` or ``:``."""
    glued = r"^[^\s0-9@]*[=:\"'(\[<{]|^[\"'(\[<{]+"
    lead = F.regexp_extract("value", glued, 0)
    core = F.regexp_replace(F.regexp_replace("value", glued, ""), r"[\"')\]>}.,;:!?*#%$&]+$", "")
    cut = runs.withColumns({"_lead": lead, "_core": core})
    return cut.select(
        *_KEY, (F.col("start") + F.length("_lead")).alias("start"), (F.col("start") + F.length("_lead") + F.length("_core")).alias("end"), F.col("_core").alias("value"), F.concat("left", "_lead").alias("left"), "right"
    ).filter(F.length("value").between(LEAST_LENGTH, MOST_LENGTH))


def _overlapping(spans: DataFrame, base: DataFrame) -> DataFrame:
    """``spans`` that meet no span of ``base`` in their text; both (doc_id, text_hash, start, end, ...)."""
    both = spans.withColumn("_base", F.lit(False)).unionByName(base.select(*_KEY, "start", "end").withColumn("_base", F.lit(True)), allowMissingColumns=True)
    up = Window.partitionBy(*_KEY).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*_KEY).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_end", F.max(F.when(F.col("_base"), F.col("end"))).over(up)).withColumn("_start", F.min(F.when(F.col("_base"), F.col("start"))).over(down))
    free = (F.coalesce("_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("_start", F.lit(2**31 - 1)) >= F.col("end"))
    return seen.filter(~F.col("_base") & free).drop("_base", "_end", "_start")


def _patterns(instances: DataFrame) -> DataFrame:
    """One row for each pattern of an instance."""
    left = F.regexp_replace(F.trim(F.lower(F.col("left"))), r"\s+", " ")
    one = F.regexp_extract(left, r"([^\s]+)$", 1)
    two = F.regexp_extract(left, r"([^\s]+ [^\s]+)$", 1)
    after = F.regexp_extract(F.lower(F.col("right")), r"^[^\s]*\s+([^\s]+)", 1)
    kind = F.when(F.col("value").contains("@"), "at").when(F.col("value").rlike(r"\p{L}"), "mix").otherwise("num")
    both = F.when((one != "") & (after != ""), F.concat_ws(" ", one, F.lit("_"), after))
    contexts = F.filter(F.array(F.when(two != "", two), both), lambda c: c.isNotNull())
    return instances.withColumn("_class", kind).withColumn("pattern", F.explode(contexts)).withColumn("pattern", F.concat_ws("|", "pattern", "_class")).drop("_class")


def score_patterns(edges: DataFrame, scratch: Scratch, rounds: int, confidence: float, support: int) -> DataFrame:
    """``(pattern, kind, conf)`` of the patterns with ``confidence`` and ``support`` after some rounds.

    ``edges(pattern, value, kind)`` are distinct; kind is empty for values that seed nothing.
    """
    width = edges.groupBy("pattern").agg(F.count("*").alias("width"))
    seeds = edges.filter("kind <> ''").select("value", "kind", F.lit(1.0).alias("belief")).distinct()
    belief, patterns = seeds, None
    for _ in range(rounds):
        belief = scratch.table(belief, "belief")
        scored = edges.select("pattern", "value").join(belief, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass")).join(width, "pattern")
        scored = scored.withColumn("conf", F.col("mass") / (F.col("width") + 0.5))
        patterns = scratch.table(scored.filter((F.col("conf") >= confidence) & (F.col("mass") >= support)).select("pattern", "kind", "conf"), "patterns")
        learned = edges.select("pattern", "value").join(patterns, "pattern").groupBy("value", "kind").agg(F.max("conf").alias("belief"))
        belief = learned.unionByName(seeds).groupBy("value", "kind").agg(F.max("belief").alias("belief"))
    return patterns


def personal_data(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``(doc_id, base, found)``: base and additional spans of every row's whole text.

    Spans are struct(start, rank, end, kind, value), ordered by start and kind.
    A null text counts as empty and has none; texts of any length are scanned
    whole.  Found spans overlap no base span; of equal confidences the first
    kind wins.  Rows that repeat doc_id and text share their spans, and each
    comes back; a null doc_id is an id like others; other columns are ignored.
    An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    with_signs = rows.filter(F.col("text").rlike("[0-9@]"))
    marks = scratch.table(marked(with_signs), "marks")
    base = marks.select(*_KEY, F.explode("base").alias("m")).select(*_KEY, "m.start", "m.end", "m.kind", "m.value", "m.left", "m.right")
    runs = _cores(marks.select(*_KEY, F.explode("runs").alias("m")).select(*_KEY, "m.*"))
    secret = F.lower("left").rlike(_ASSIGNED) & (F.length("value") >= LEAST_SECRET) & F.col("value").rlike("^[^ ]*[0-9][^ ]*$")
    free = _overlapping(runs, base).withColumn("kind", F.when(secret, "secret").otherwise(""))
    free = scratch.table(_patterns(free), "instances")
    edges = free.select("pattern", "value", "kind").unionByName(_patterns(base).select("pattern", "value", "kind"))
    edges = scratch.table(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    patterns = score_patterns(edges, scratch, rounds, confidence, support)

    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(FOUND_KINDS) for x in (k, i)]), F.col("kind"))
    known = free.drop("kind").join(patterns, "pattern").withColumn("rank", rank)
    best = known.groupBy(*_KEY, "start", "end", "value").agg(F.min(F.struct(-F.col("conf"), "rank", "kind")).alias("b"))
    span = F.struct("start", F.col("b.rank").alias("rank"), "end", F.col("b.kind").alias("kind"), "value")
    found = best.groupBy(*_KEY).agg(F.array_sort(F.collect_list(span)).alias("found"))
    entities = marks.select(*_KEY, F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value"))).alias("base"))
    entities = entities.filter(F.size("base") > 0).dropDuplicates(_KEY)

    out = rows.select(*_KEY)
    for part, name in ((entities, "base"), (found, "found")):
        part = part.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), name)
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    empty = F.array().cast(_SPAN)
    return out.select("doc_id", F.coalesce("base", empty).alias("base"), F.coalesce("found", empty).alias("found"))
