"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two order-1 models over a 66-letter alphabet are trained from labelled samples: random strings (keys, tokens, digests)
and ordinary identifiers. A candidate string of 20 or more key characters is a secret if the random model explains it
better by a margin for each character. Matching, training and scoring are DataFrame functions only; what reaches the
driver is the bigram table, whose size is fixed by the alphabet.

Spans are code points, end exclusive. Spark gives no match offsets, so a pattern's matches and the pieces between them
are taken with the same pattern, and their lengths add up to the offsets. Running sums are made in chunks, each match is
looked at once, and overlaps are told by running ends of the sorted spans, so a text with very many matches costs
little more than its length.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm.common import table, unused

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the maximal runs of [0-9a-f]+ that have 16 or more
#: Kinds in the order that settles ties of start: pattern, what must be long enough, and how long.
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
#: Nats a character by which the random model must win.
MARGIN = 0.25
#: Items that a running sum takes at a time.
CHUNK = 256

_WORDS = (
    "account action active address alert array async available balance batch binary bucket buffer build cache call cancel channel "
    "check child class client cluster code column command commit common config connection content context control count create "
    "current customer data database date default delete delta device directory document domain driver element enable engine entry "
    "error event example execute export factory field file filter folder format function gateway generate global graph group "
    "handle header helper history image import index information input instance interface internal invoice item join key language "
    "latest length level library limit line link list load local location log manager map market match memory message method metric "
    "model module monitor name network node notification number object offset operation option order output package page parameter "
    "parent parse partition password path pattern payment performance permission pipeline point policy pool position price process "
    "product profile project property protocol provider public query queue range record reference region register release remote "
    "report request resource response result return review role route rule runtime sample schedule schema scope script search "
    "section security select sequence server service session setting shared signature size snapshot socket source stage start state "
    "status storage stream string structure subject submit success summary system table target task template test text thread time "
    "token topic total trace transaction transfer transform transport tree trigger type unique update upload user utility validate "
    "value variable vector version view virtual volume window worker workflow write"
).split()


def labelled_samples(count: int = 4000, first: int = 0) -> list[tuple[str, int]]:
    """(string, 1 if random) made by rule from the hashes of count numbers from first: base64, hexadecimal and
    alphanumeric strings of 20 to 64 characters, and identifiers of two to five words in camel, snake, kebab and path
    style, some with a number. Other numbers give other samples."""
    out = []
    for i in range(first, first + count):
        d = b"".join(hashlib.sha256(f"{i}:{k}".encode()).digest() for k in range(4))
        n = 20 + d[0] % 45
        letters = (ALPHABET[:64], "0123456789abcdef", ALPHABET[:62])[i % 3]
        out.append(("".join(letters[(d[2 * j] * 256 + d[2 * j + 1]) % len(letters)] for j in range(1, n + 1) if 2 * j + 1 < len(d)), 1))
        words = [_WORDS[(d[100 + 2 * j] * 256 + d[101 + 2 * j]) % len(_WORDS)] for j in range(2 + d[99] % 4)]
        style = i % 5
        name = ("".join(w.capitalize() for w in words), "_".join(words), "-".join(words), "/".join(words), "".join(words))[style]
        out.append((name + (str(d[98] % 100) if d[97] % 4 == 0 else ""), 0))
    return out


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios random : ordinary, one for each pair of letters; first the pairs of the start with each
    letter. samples: (text, random). Letters outside the alphabet share its last place."""
    n = len(ALPHABET) + 1
    text = F.concat(F.lit("\u0000"), "text")
    pairs = samples.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substring(text, i, 2))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}

    def letter(c: str) -> int:
        return 0 if c == "\u0000" else ALPHABET.find(c) + 1 or n

    grid = [[[smooth] * (n + 1) for _ in range(n + 1)] for _ in range(2)]
    for (kind, pair), count in counts.items():
        if len(pair) == 2:
            grid[kind][letter(pair[0])][letter(pair[1])] += count
    table_ = []
    for a in range(n + 1):
        one, two = (math.log(sum(grid[k][a])) for k in (1, 0))
        table_ += [round(math.log(grid[1][a][b]) - one - math.log(grid[0][a][b]) + two, 4) for b in range(n + 1)]
    return table_


def ratio(token: Column, weights: list[float]) -> Column:
    """The log-likelihood ratio of a string, for each of its characters."""
    n = len(ALPHABET) + 2
    known = F.array(*[F.lit(w) for w in weights])

    def letter(c: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), c)
        return F.when(at == 0, n - 1).otherwise(at)

    letters = F.transform(F.split(token, ""), letter)
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    total = F.aggregate(letters, start, lambda acc, c: F.struct(c.alias("at"), (acc["sum"] + F.element_at(known, acc["at"] * n + c + 1)).alias("sum")))
    return total["sum"] / F.greatest(F.length(token), F.lit(1))


def _bound(value: Column, make) -> Column:
    """make(value) with value computed once: as a lambda's variable, not as an expression that each use repeats."""
    return F.transform(F.array(value), make)[0]


def _chunks(items: Column) -> Column:
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))


def _running(items: Column, join, zero: int) -> Column:
    """Running values of an associative join over integers, in chunks, since an array that grows is copied each time."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(join(acc["at"], x))).alias("out"))

    def before(acc: Column, part: Column) -> Column:
        return F.struct(join(acc["at"], F.element_at(part, -1)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    inner = F.transform(_chunks(items), lambda part: F.aggregate(part, start, step)["out"])

    def joined(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, F.aggregate(parts, start, before)["out"], lambda part, at: F.transform(part, lambda x: join(at, x))))

    return _bound(inner, joined)


def _spans(text: Column, pattern: str, kind: str, rank: int, keep) -> Column:
    """Matches of a pattern as structs (start, rank, end, kind), those for which keep(match) holds."""

    def placed(found: Column, ends: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            return F.struct((ends[i] - F.length(match)).alias("start"), F.lit(rank).alias("rank"), ends[i].alias("end"), F.when(keep(match), kind).alias("kind"))

        return F.filter(F.transform(found, one), lambda s: s["kind"].isNotNull())

    def walked(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda x, y: F.length(x) + F.length(y))
        return _bound(_bound(lengths, lambda n: _running(n, lambda x, y: x + y, 0)), lambda ends: placed(found, ends))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return F.when(text.rlike(pattern), _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walked)).otherwise(none)


def _ends(spans: Column) -> Column:
    """The largest end up to each span, of spans sorted by start."""
    return _bound(F.transform(spans, lambda s: s["end"]), lambda e: _running(e, F.greatest, 0))


def _with_models(spans: Column) -> Column:
    """Sorted spans without those of the models that a fixed pattern's span touches: one that started at or before them
    and ends later, or the next one, if it starts before they end."""
    models, far = len(BASE), (1 << 31) - 1

    def told(spans: Column, ends: Column, nexts: Column) -> Column:
        marked = F.transform(spans, lambda s, i: F.struct(s.alias("s"), ((s["rank"] < models) | ((ends[i] <= s["start"]) & (nexts[i] >= s["end"]))).alias("ok")))
        return F.transform(F.filter(marked, lambda m: m["ok"]), lambda m: m["s"])

    def walked(spans: Column) -> Column:
        ends = _bound(F.transform(spans, lambda s: F.when(s["rank"] < models, s["end"]).otherwise(0)), lambda e: _running(e, F.greatest, 0))
        starts = F.transform(F.reverse(spans), lambda s: F.when(s["rank"] < models, s["start"]).otherwise(far))
        nexts = F.reverse(_bound(starts, lambda e: _running(e, F.least, far)))
        return _bound(ends, lambda e: _bound(nexts, lambda n: told(spans, e, n)))

    return F.when(F.exists(spans, lambda s: s["rank"] == models), _bound(spans, walked)).otherwise(spans)


def base_spans(text: Column) -> list[Column]:
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        out.append(_spans(text, pattern, kind, rank, lambda m, p=pattern, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n))
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def weights_of(spark: SparkSession) -> list[float]:
    return train(spark.createDataFrame(labelled_samples(), "text string, random int"))


def scan(docs: DataFrame, weights: list[float], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans of the fixed patterns) and found (all spans).

    A span of the models has kind markov and is added unless a base span touches it. Defined results: a null or empty
    text has no spans; repeated rows and null ids are scanned like any row; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    kinds = base_spans(F.col("_text"))
    markov = _spans(F.col("_text"), CANDIDATE, "markov", len(BASE), lambda m: ratio(m, weights) >= margin)
    spans = own.select("doc_id", *[k.alias(f"_{name}") for k, (name, *_) in zip(kinds, BASE)], markov.alias("_markov"))
    return spans.withColumns({"base": F.array_sort(F.concat("_assign", "_access", "_hex")), "_all": F.array_sort(F.concat("_assign", "_access", "_hex", "_markov"))}).select(
        "doc_id", *[F.size(f"_{name}").cast("long").alias(f"n_{name}") for name, *_ in BASE], "base", _with_models(F.col("_all")).alias("found")
    )


def redact(docs: DataFrame, weights: list[float], margin: float = MARGIN, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret in text replaced by a mark; other texts and all other columns stay, n_chars
    follows the new text. Spans that overlap become one mark. A null or empty text stays as it is; repeated rows and null
    ids are treated like any row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.array_sort(F.concat(*base_spans(text), _spans(text, CANDIDATE, "markov", len(BASE), lambda m: ratio(m, weights) >= margin)))

    def merged(spans: Column, ends: Column) -> Column:
        """(start, end) of each run of spans that overlap: a run begins where no span before reaches, and ends where the
        last one before the next run does."""
        n = F.size(spans)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.when(i > 0, F.element_at(spans, i + 1)["start"] >= F.element_at(ends, F.greatest(i, F.lit(1)))).otherwise(True))
        return _bound(firsts, lambda f: F.transform(f, lambda i, k: F.struct(F.element_at(spans, i + 1)["start"].alias("start"), F.element_at(ends, F.when(k + 1 < F.size(f), F.element_at(f, F.least(k + 2, F.size(f)))).otherwise(n)).alias("end"))))

    def marked(runs: Column) -> Column:
        """The text with its runs replaced. Each chunk of runs has its own part of the text, as a substring is looked for
        from the start of its string."""

        def one(part: Column, at: Column, own: Column) -> Column:
            pieces = F.transform(part, lambda r, k: _bound(F.when(k > 0, F.element_at(part, F.greatest(k, F.lit(1)))["end"]).otherwise(at), lambda p: F.concat(F.substring(own, p - at + 1, r["start"] - p), F.lit(mark))))
            return F.array_join(pieces, "")

        def chunk(parts: Column) -> Column:
            def each(part: Column, k: Column) -> Column:
                last = F.element_at(part, -1)["end"]
                begin = F.when(k > 0, F.element_at(F.element_at(parts, F.greatest(k, F.lit(1))), -1)["end"]).otherwise(0)
                return _bound(begin, lambda at: _bound(F.substring(F.col("text"), at + 1, last - at), lambda own: one(part, at, own)))

            return F.array_join(F.transform(parts, each), "")

        tail = F.element_at(runs, -1)["end"]
        return F.concat(_bound(_chunks(runs), chunk), F.substring(F.col("text"), tail + 1, F.length("text")))

    name = unused(docs, "__spans")
    walked = _bound(F.col(name), lambda spans: _bound(_bound(_ends(spans), lambda ends: merged(spans, ends)), marked))
    hit = docs.withColumn(name, every)
    out = hit.withColumn("text", F.when(F.size(name) > 0, walked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(name)


def op3(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), weights_of(spark))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
