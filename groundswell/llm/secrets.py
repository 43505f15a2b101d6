"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

A token (a run of key-like characters that no match of a fixed pattern covers) is a secret if its first-order Markov
log-likelihood as a random string exceeds that as an ordinary identifier by a threshold, which is higher for tokens of
less than WHOLE characters, as 1 / length. Both models are trained from labelled samples by counting character pairs. Everything runs as DataFrame expressions.

Spans are in code points, end exclusive. Defined results: a null text is an empty one and has no spans; null ids and
repeated rows pass through; extra columns are kept by `with_secrets` and `redacted`, whose own columns are named by
the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, table, unused

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of capitals and digits has one leftmost match, so the least length can be part of the pattern; likewise for hex.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{8,}"  # what is shorter cannot reach its threshold
WHOLE = 20

#: Characters that the Markov models know: every one that a token can hold.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Words that ordinary identifiers in the built-in labelled samples are joined from.
IDENTIFIER_WORDS = (
    "user account order item price total count index value name type state event message request response handler "
    "manager service client server session config option default buffer stream reader writer parser token field table "
    "column record query result list map set node tree graph path file image video audio page link button form input "
    "output number string create update delete insert select find load save open close start stop run build test check "
    "parse format convert send receive read write get add remove first last next previous current active version"
).split()
#: Words of English, German, French and Spanish prose, whose letter pairs identifiers lack.
PROSE_WORDS = (
    "which should through would thought whether height though nothing everything strength something together without however "
    "beautiful quickly usually government knowledge information yesterday children question following business experience "
    "nicht zwischen wissenschaft gesellschaft geschichte deutschland verschiedene entwicklung möglichkeit wirtschaft schreiben "
    "bundesrepublik herrschaft pflicht kopfschmerzen jahrhundert gemeinschaft verständnis einschätzung tatsächlich hauptstadt "
    "toujours beaucoup aujourd quelque pourquoi maintenant heureux nombreux travaux nouveaux jeunesse royaume ailleurs besoin "
    "question langue peuple siècle lequel soixante oiseaux cheveux chevaux feuille bouteille "
    "siempre también ciudad trabajo quisiera pueblo mejor gobierno desarrollo construcción izquierda derecho corazón guerra "
    "llamaba caballo muchacho hijo jajaja aquello pequeño cualquier bueno nueve"
).split()


def running(values: Column, step, zero: int = 0, block: int = 512) -> Column:  # noqa: ANN001
    """Exclusive running results of an array of longs under an associative step, such as sum or maximum; in blocks, so that
    long arrays are not copied for each element."""
    start_at = F.lit(zero).cast("long")

    def scan(a: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(a, start, lambda s, v: F.struct(step(s["at"], v).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def by_blocks(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, block))
        whole = F.transform(parts, lambda p: F.aggregate(p, start_at, step))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, scan(whole, start_at), lambda p, base: scan(p, base))))

    return let(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).when(F.size(a) <= block, scan(a, start_at)).otherwise(by_blocks(a)))


def prefix_sums(values: Column) -> Column:
    return running(values, lambda x, y: x + y)


def reached(values: Column) -> Column:
    """The largest of the values before each, 0 before the first."""
    return running(values, lambda x, y: F.greatest(x, y))


SPAN = "array<struct<start:bigint,kind:int,stop:bigint,hit:string>>"


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """The leftmost, non-overlapping matches of a pattern that never matches emptiness.

    Spark returns matches without places; those follow from the lengths of matches and of what lies between them.
    """

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda g: F.char_length(g).cast("long"))
        steps = lambda g: F.zip_with(g, hits, lambda a, h: a + F.char_length(h))
        return let(
            gaps,
            lambda g: F.zip_with(
                F.zip_with(prefix_sums(steps(g)), g, lambda before, gap: before + gap),
                hits,
                lambda start, h: F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(h)).alias("stop"), h.alias("hit")),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda hits: F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(placed(hits).cast(SPAN)))


def base_spans(text: Column) -> Column:
    """Matches of the three fixed patterns, sorted by start, then kind."""
    none = F.array().cast(SPAN)
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), F.filter(spans_of(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 6)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS, 1)).otherwise(none)
    return F.sort_array(F.concat(assign, access, spans_of(text, HEX, 2)))


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Built-in labelled samples (text, label): label 1 for random strings, 0 for ordinary identifiers, n of each.

    Random strings are digests in hex, base 64 and capitals; identifiers join two to four common words in the usual
    ways, some with a number at the end; a few are common words of prose, joined, or rules of one mark. All follow from
    the row number alone.
    """
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    rand = F.when(i % 4 == 0, F.substring(digest, 1, 32)).when(i % 4 == 1, F.upper(F.regexp_replace(b64, "[+/]", "7"))).otherwise(b64)
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    word = lambda k: F.get(words, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(IDENTIFIER_WORDS))).cast("int"))
    parts = F.slice(F.array(*[word(k) for k in range(4)]), F.lit(1), (F.pmod(F.xxhash64(i, F.lit("n")), F.lit(3)) + 2).cast("int"))
    style = F.pmod(F.xxhash64(i, F.lit("style")), F.lit(5))
    joined = F.when(style == 0, F.array_join(F.transform(parts, F.initcap), "")).when(style == 1, F.array_join(parts, "_")).when(style == 2, F.upper(F.array_join(parts, "_"))).when(style == 3, F.array_join(parts, "-")).otherwise(F.array_join(parts, "/"))
    number = F.when(F.pmod(F.xxhash64(i, F.lit("number")), F.lit(2)) == 0, F.pmod(i, F.lit(1000)).cast("string")).otherwise(F.lit(""))
    prose = F.array(*[F.lit(w) for w in PROSE_WORDS])
    said = lambda k: F.get(prose, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PROSE_WORDS))).cast("int"))
    plain = F.when(style == 0, F.initcap(said("p"))).when(style == 1, F.repeat(F.substring(F.lit("-_=+/"), (F.pmod(i, F.lit(5)) + 1).cast("int"), F.lit(1)), 24)).otherwise(F.concat(said("p"), said("q")))
    ordinary = F.when(F.pmod(F.xxhash64(i, F.lit("prose")), F.lit(8)) == 0, plain).otherwise(F.concat(joined, number))
    ids = spark.range(n)
    return ids.select(rand.alias("text"), F.lit(1).alias("label")).union(ids.select(ordinary.alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row of the alphabet squared: random over ordinary.

    samples: text and label (1 random, 0 ordinary); nulls are ignored. The result has a fixed size.
    """
    chars = F.filter(F.split(F.col("text"), ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    pairs = samples.where(F.col("text").isNotNull() & F.col("label").isin(0, 1)).select(
        "label", F.explode(let(chars, lambda c: F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, k: F.concat(c[k], x)))).alias("pair")
    )
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    size, table_ = len(ALPHABET), []
    rows = {(y, a): sum(counts.get((y, a + b), 0) for b in ALPHABET) for y in (0, 1) for a in ALPHABET}
    for a in ALPHABET:
        for b in ALPHABET:
            p, q = (math.log((counts.get((y, a + b), 0) + smoothing) / (rows[y, a] + smoothing * size)) for y in (1, 0))
            table_.append(p - q)
    return table_


def literal_array(values: list[float], kind: str) -> Column:
    """An array that the optimiser folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """The summed log-likelihood ratio of a token's character pairs."""
    codes = literal_array([max(0, ALPHABET.find(chr(c))) for c in range(128)], "int")
    ratios, size = literal_array(model, "double"), len(ALPHABET)
    return let(
        F.transform(F.split(token, ""), lambda c: F.get(codes, F.ascii(c))),
        lambda c: F.aggregate(F.transform(F.slice(c, F.lit(2), F.size(c)), lambda x, k: F.get(ratios, c[k] * size + x)), F.lit(0.0), lambda a, b: a + b),
    )


def uncovered(base: Column, tokens: Column) -> Column:
    """Tokens that lie in no base span. All spans in one order, a base span before a token that begins with it: a token is
    covered if a base span before it reaches its end."""

    def apart(every: Column) -> Column:
        stops = F.transform(every, lambda s: F.when(s["kind"] < 3, s["stop"]).otherwise(F.lit(0).cast("long")))
        marked = F.zip_with(every, reached(stops), lambda s, far: F.when((s["kind"] == 3) & (far < s["stop"]), s))
        return F.filter(marked, lambda s: s.isNotNull())

    return F.when(F.size(base) == 0, tokens).otherwise(let(F.sort_array(F.concat(base, tokens)), apart))


def random_spans(text: Column, base: Column, model: list[float], threshold: float) -> Column:
    """Tokens, other than those within a base span, that the models take for random strings."""
    tokens = uncovered(base, spans_of(text, TOKEN, 3))
    return F.filter(tokens, lambda s: likelihood_ratio(s["hit"], model) >= threshold * F.greatest(F.lit(1.0), WHOLE / F.char_length(s["hit"])))


def with_secrets(df: DataFrame, samples: DataFrame | None = None, threshold: float = 10.0, text: str = "text", base: str = "base_spans", extra: str = "random_spans") -> DataFrame:
    """df with two columns of spans (start, kind, stop, hit): of the fixed patterns, and those that the models add."""
    model = train(samples if samples is not None else labelled_samples(df.sparkSession))
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(base, base_spans(whole)).withColumn(extra, random_spans(whole, F.col(base), model, threshold))


CHUNK = 4096  # code points; a text is cut into chunks, so that no cut looks for its place from the beginning


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with mask in place of each span; overlapping spans are replaced as one. Work is linear in text and spans."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def rebuilt(chunk: Column, every: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
            piece = F.substr(F.array_join(F.slice(chunk, first + 1, last - first + 1), ""), (a % CHUNK + 1).cast("int"), (b - a).cast("int"))
            return F.when(b > a, piece).otherwise(F.lit(""))

        before = reached(F.transform(every, lambda s: s["stop"]))
        pieces = F.zip_with(every, before, lambda s, at: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit(mask))).otherwise(F.lit("")))
        rest = cut(F.array_max(F.transform(every, lambda s: s["stop"])), F.char_length(text).cast("long"))
        return F.concat(F.array_join(pieces, ""), rest)

    return let(chunks, lambda chunk: let(spans, lambda every: rebuilt(chunk, every)))


def redacted(df: DataFrame, mask: str = "[SECRET]", text: str = "text", **options: object) -> DataFrame:
    """df with every secret in its text replaced by mask. Null stays null; a text without spans stays as it is."""
    base, extra = unused(df, "base_spans"), unused(df, "random_spans")
    found = with_secrets(df, text=text, base=base, extra=extra, **options)
    clean = (F.size(base) == 0) & (F.size(extra) == 0)
    out = F.when(clean, F.col(text)).otherwise(masked(F.col(text), F.sort_array(F.concat(base, extra)), mask))
    return found.withColumn(text, out).drop(base, extra)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, every = F.col("base_spans"), F.sort_array(F.concat("base_spans", "random_spans"))
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))


QUERIES = {"op2_secret_scans": op2_secret_scans}
ORACLES: dict[str, str] = {}
