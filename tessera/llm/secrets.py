"""Secret scans: base patterns, and a randomness test battery that adds spans.

Base patterns (leftmost, non-overlapping for each kind) are ``assign``, ``access`` and ``hex``. The battery takes
maximal runs of 16 or more key characters with a letter, outside base spans, infers the smallest encoding that holds a
run, and tests it against uniform random symbols of that encoding: a chi-squared test of symbol counts, a runs test about
the middle of the alphabet, and the lag-1 serial correlation. Fisher's method joins the three p-values; a high one means
that the run looks like a random key.

False-discovery control. A false discovery is written text that is taken for a key, so the null is written text, not
uniform symbols. It is measured: every document lends one decoy, the letters of a stretch of its own text without the
blanks, as long as the runs of one length class and, for runs of mixed case, with capitals at the starts of words. The
same battery tests the decoys. For each family (length class; one case or mixed) runs with p >= t are added as
``random`` for the smallest t at which

    (decoys with p >= t, plus 1) / (decoys plus 1)  <=  ``rate`` * (runs with p >= t) / (all runs)

This is the share of written text expected among what is added. Short runs, where the tests have little power, so need
a higher p than long ones, and a family with too few decoys or too few random runs adds nothing.

Scale. DataFrame functions only. A text is searched within its row; what is found is a narrow table. The decision needs
counts of p-values on a fixed grid for each family: at most a few ten thousand rows, whatever the input.

Positions count code points, ends are exclusive. Nulls and empty texts have no spans and lend no decoy. Repeated rows
have equal results and lend a decoy each. Rows without an id are searched too. ``redact`` keeps extra columns whatever
their names; different texts of one id have their own spans. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, marked, stage, table
from .native import let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: At least 20 and 24 characters. A greedy match is a maximal run, so this finds what the shorter forms find and keep.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Length classes of runs begin here.
LENGTHS = (16, 20, 24, 32, 40, 48, 64)
#: Kinds in the order of the output.
KINDS = ("assign", "access", "hex", "random")
#: Encodings by growing alphabet. A run has the first that holds all its symbols.
ENCODINGS = (
    ("0123456789abcdef", "[0-9a-f]+"),
    ("0123456789ABCDEF", "[0-9A-F]+"),
    ("abcdefghijklmnopqrstuvwxyz", "[a-z]+"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[A-Z]+"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "[A-Z2-7]+"),
    ("0123456789abcdefghijklmnopqrstuvwxyz", "[0-9a-z]+"),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[0-9A-Z]+"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "[A-Za-z]+"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "[A-Za-z0-9]+"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "[A-Za-z0-9+/]+"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "[A-Za-z0-9_-]+"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "[A-Za-z0-9+/_-]+"),
)
GRID, TOP = 64, 4095
_SPAN = "array<struct<start:int,end:int,text:string>>"


#: Lengths are summed in blocks of so many, and then over blocks.
_BLOCK = 64


def _before(sizes: Column) -> Column:
    """For each element the sum of those before it, in about 64 steps an element."""

    def summed(x: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(x, start, n), F.lit(0), lambda s, v: s + v)

    def placed(blocks: Column) -> Column:
        starts = F.transform(blocks, lambda _, b: summed(blocks, F.lit(1), b))
        return let(starts, lambda at: F.transform(sizes, lambda _, i: F.get(at, F.floor(i / _BLOCK).cast("int")) + summed(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda b: summed(sizes, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(sizes) > 0, let(blocks, placed)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end and text of ``group`` of every match: what lies between matches and the matches, laid end to end."""

    def laid(gaps: Column, hits: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
        starts = let(sizes, lambda x: F.zip_with(_before(x), hits, lambda at, h: F.struct(at.alias("at"), F.length(h).alias("n"))))
        shift = lambda s, i: s["at"] + F.length(F.get(gaps, i))
        found = F.transform(starts, lambda s, i: F.struct(shift(s, i).alias("start"), (shift(s, i) + s["n"]).alias("end")))
        own = hits if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.zip_with(found, own, lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("text")))

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: laid(gaps, hits)))


def _tail(z: Column) -> Column:
    """P(normal > z), by a logistic curve with a cubic term."""
    return 1.0 / (1.0 + F.exp(F.least(F.greatest(1.5976 * z + 0.070566 * z * z * z, F.lit(-700.0)), F.lit(700.0))))


def _battery(run: Column) -> Column:
    """Combined p-value of a run under uniform random symbols of its encoding. Each sum is bound once (``let``)."""
    which = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        which = F.when(run.rlike(f"^{ENCODINGS[i][1]}=*$"), i).otherwise(which)
    alphabets = F.array(*[F.lit(symbols) for symbols, _ in ENCODINGS])
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, v: s + f(v))
    two = lambda z: F.least(2 * _tail(F.abs(z)), F.lit(1.0))

    def chi(x: Column, n: Column, a: Column) -> Column:
        square = total(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
        cube = F.pow(F.greatest(square * a / n - n, F.lit(0.0)) / (a - 1), F.lit(1.0 / 3))
        return _tail((cube - (1 - 2 / (9 * (a - 1)))) / F.sqrt(2 / (9 * (a - 1))))

    def runs(x: Column, n: Column, a: Column) -> Column:
        side = F.transform(x, lambda v: 2 * v >= a)
        return let(side, lambda h: let(F.size(F.filter(h, lambda v: v)).cast("double"), lambda high: let(2 * high * (n - high) / n + 1, lambda mean: _about(h, mean, n))))

    def _about(side: Column, mean: Column, n: Column) -> Column:
        changes = F.size(F.filter(F.transform(side, lambda v, i: v != F.coalesce(F.get(side, i - 1), v)), lambda d: d))
        return two((1.0 + changes - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))))

    def lag(x: Column, n: Column) -> Column:
        def correlated(c: Column) -> Column:
            own, next_ = total(c, lambda v: v * v), F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, i: s + F.get(c, i) * F.get(c, i - 1))
            return let(own, lambda spread: two(F.when(spread > 0, next_ / spread * F.sqrt(n)).otherwise(F.sqrt(n))))

        return let(total(x, lambda v: v) / n, lambda mid: let(F.transform(x, lambda v: v - mid), correlated))

    def tests(x: Column, a: Column) -> Column:
        n = F.size(x).cast("double")
        logs = F.array(*[F.ln(F.greatest(p, F.lit(1e-300))) for p in (chi(x, n, a), runs(x, n, a), lag(x, n))])
        return let(-total(logs, lambda v: v), lambda h: F.exp(-h) * (1 + h + h * h / 2))

    def numbered(al: Column) -> Column:
        places = F.transform(F.split(F.rtrim(run, F.lit("=")), ""), lambda c: (F.instr(al, c) - 1).cast("double"))
        return let(F.filter(places, lambda v: v >= 0), lambda x: tests(x, F.length(al).cast("double")))

    return let(F.get(alphabets, which), numbered)


def _cell(p: Column) -> Column:
    """Place of a p-value on the grid; 0 is the highest."""
    return F.least(F.greatest(F.floor(-F.ln(F.greatest(p, F.lit(1e-300))) * GRID), F.lit(0)), F.lit(TOP)).cast("int")


def _family(n: Column, mixed: Column) -> Column:
    """Number of a family: twice the length class, and 1 for mixed case."""
    out = F.lit(0)
    for k, least in enumerate(LENGTHS):
        out = F.when(n >= least, 2 * k).otherwise(out)
    return out + mixed.cast("int")


def _mixed(run: Column) -> Column:
    return run.rlike("[a-z]") & run.rlike("[A-Z]")


def _decoys(doc_id: Column, text: Column) -> Column:
    """Letters of a stretch of a text, as long as runs of one length class: (one case, mixed case); null where too short."""
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(name), doc_id, F.length(text)), n)
    k = draw("class", F.lit(len(LENGTHS))).cast("int")
    least = F.get(F.array(*[F.lit(v) for v in LENGTHS]), k)
    width = F.get(F.array(*[F.lit(b - a) for a, b in zip(LENGTHS, (*LENGTHS[1:], 2 * LENGTHS[-1]), strict=True)]), k)
    n = least + draw("length", width).cast("int")
    room = F.greatest(F.length(text) - 4 * n, F.lit(1))
    stretch = F.substring(text, draw("place", room).cast("int") + 1, 4 * n)
    words = F.initcap(F.regexp_replace(stretch, "[^A-Za-z]+", " "))
    letters = F.substring(F.translate(words, " ", ""), F.lit(1), n)
    return let(letters, lambda x: F.when(F.length(x) == n, F.array(F.lower(x), x)).otherwise(F.array().cast("array<string>")))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex (spans), and tested (start, end, family, cell of the p-value); decoys start at -1."""
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(_SPAN)
    low = F.lower(text)
    named = F.contains(low, F.lit("pass")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    bare = lambda xs: F.transform(xs, lambda s: F.struct(s["start"], s["end"]))
    assign = F.filter(F.when(named, spans_of(text, ASSIGN, 2)).otherwise(none), lambda s: F.length(s["text"]) >= 6)
    access = F.when(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS)).otherwise(none)
    long = text.rlike("[A-Za-z0-9+/_-]{16}")
    hexes = F.when(long, F.when(text.rlike("[0-9a-f]{24}"), spans_of(text, HEX)).otherwise(none)).otherwise(none)
    runs = F.when(long, spans_of(text, RUN)).otherwise(none)
    x = docs.select("doc_id", bare(assign).alias("assign"), bare(access).alias("access"), bare(hexes).alias("hex"), runs.alias("runs"), _decoys(F.col("doc_id"), text).alias("decoys"))
    base = F.concat("assign", "access", "hex")
    free = lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    runs = F.filter("runs", lambda s: s["text"].rlike("[A-Za-z]") & free(s))
    both = F.concat(F.transform(runs, lambda s: F.struct(s["start"], s["end"], s["text"])), F.transform("decoys", lambda d: F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), d.alias("text"))))
    tested = F.transform(both, lambda s: F.struct(s["start"], s["end"], _family(F.length(s["text"]), _mixed(s["text"])).alias("family"), _cell(_battery(s["text"])).alias("cell")))
    return x.select("doc_id", "assign", "access", "hex", tested.alias("tested"))


def _limits(found: DataFrame, rate: float) -> DataFrame:
    """One row: map from family to the last grid cell whose runs are added (-1: none)."""
    each = found.select(F.explode("tested").alias("r")).select("r.family", "r.cell", (F.col("r.start") >= 0).cast("int").alias("run"))
    cells = each.groupBy("family", "cell").agg(F.sum("run").alias("runs"), F.sum(1 - F.col("run")).alias("decoys"))
    each = cells.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("cell", "runs", "decoys"))).alias("cells"))  # at most TOP + 1 cells
    total = lambda name: F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c[name])
    start = F.struct(F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("decoys"), F.lit(-1).alias("last"))

    def further(acc: Column, c: Column) -> Column:
        n, d = acc["runs"] + c["runs"], acc["decoys"] + c["decoys"]
        good = (n > 0) & ((d + 1) * F.col("all_runs") <= rate * n * (F.col("all_decoys") + 1))
        return F.struct(n.alias("runs"), d.alias("decoys"), F.when(good, c["cell"]).otherwise(acc["last"]).alias("last"))

    last = F.aggregate("cells", start, further, lambda acc: acc["last"])
    each = each.select("family", "cells", total("runs").alias("all_runs"), total("decoys").alias("all_decoys")).select("family", last.alias("last"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("family", "last"))).alias("limits"))


def secret_spans(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, and arrays of (start, end): assign, access, hex, random."""
    found = stage(_found(docs), "spans")
    limits = stage(_limits(found, rate), "limits")
    added = F.filter("tested", lambda r: (r["start"] >= 0) & (r["cell"] <= F.coalesce(F.try_element_at(F.col("_limits"), r["family"]), F.lit(-1))))
    out = found.withColumn("_limits", limits.scalar())
    return out.select("doc_id", "assign", "access", "hex", F.transform(added, lambda r: F.struct(r["start"], r["end"])).alias("random"))


def spans_string(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans, by start and then kind, joined by commas."""

    def named(kind: str, rank: int) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("text")))

    one = [named(k, i) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.sort_array(F.concat(*one)), lambda s: s["text"]), ",")


def redact(docs: DataFrame, mask: str = "[secret]", rate: float = 0.05) -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mask`` (overlapping spans by one)."""
    text, key, spans, maybe = F.col("text"), free_name(docs, "key"), free_name(docs, "spans"), free_name(docs, "maybe")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))  # repeated ids may have different texts
    some = secret_spans(keyed.select(F.col(key).alias("doc_id"), "text"), rate).select(F.col("doc_id").alias(key), F.array_sort(F.array_distinct(F.concat("assign", "access", "hex", "random"))).alias(spans))
    some = stage(some.where(F.size(spans) > 0).groupBy(key).agg(F.first(spans).alias(spans)), "found")
    split = marked(keyed, key, some, maybe)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        more = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], more)).alias("out"))

    clean = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    hit = split.where(F.col(maybe)).join(some, key, "left").withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(clean))
    return split.where(~F.col(maybe)).select(docs.columns).union(hit.select(docs.columns))


def op4_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = secret_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return x.select("doc_id", *counts[:3], F.sha2(spans_string(KINDS[:3]), 256).alias("base_sha256"), spans_string(KINDS).alias("spans"), counts[3])
