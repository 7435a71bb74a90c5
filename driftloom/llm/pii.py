"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are what the base expressions find (email, ip, card, phone), and values that are
assigned to the name of a secret.  A candidate is a run of characters with a digit or an at
sign, up to a separator; groups of digits with single blanks between them are one
candidate, so no base span leaves its candidate.  Every candidate is an instance, and its
patterns are of four families: the word before it, the one before that, the word after
it, and the punctuation around it, each with the instance's class (digits, letters and
digits, or an at sign).

A word makes a pattern only if a good part of all its occurrences in the corpus stand there
beside a candidate (``MIN_RATE``), which leaves out words that stand anywhere.  Over the
graph of patterns and instances, scores go to and fro.  A pattern is worth the lower
Wilson bound of the share of its distinct instances that are of the kind: seeds count 1,
those of other kinds or that a base check rejects (a Luhn failure) 0, others their score
from their other patterns alone, so that no pattern supports itself; what nothing is known
of counts as ``UNKNOWN`` of an instance.  An instance's score is the noisy-or of its patterns of high
worth.  Worths only rise; rounds go on until one brings no further pattern of high worth.

An occurrence is marked if one of its patterns has a high worth, and its instance has such
patterns of two families at least and a high score.

Positions are code points, ends exclusive.  All expressions run in linear time over a
text: the quantifiers are possessive and begin only where a run begins, or a context of
``CONTEXT`` code points is all they see.  Beyond 262,144 candidates in one text the sums of their
positions take quadratic time (``arrays.py``), with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.arrays import cut, largest_before, let, pieces, sums_before
from driftloom.llm.common import Steps, quoted, unused, whole_text

#: The kinds in order.
KINDS = ("email", "ip", "card", "phone")
_EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts without these can't have a match that counts.
_NEEDED = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){15}",
    "phone": r"\+[0-9][ ().0-9-]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Characters between candidates, and around one that aren't part of what it says.
_SEPARATORS = r"\s,;|\"'<>{}\[\]=&"
_CANDIDATE = (
    rf"(?<![^{_SEPARATORS}])[^{_SEPARATORS}0-9@]*+[0-9@][^{_SEPARATORS}]*+"
    rf"(?:(?<=[0-9().-]) [ ().-]*+[0-9][^{_SEPARATORS}]*+)*+"
)
_LEAD, _TAIL = r"^[(]++", r"(?<![).:!?])[).:!?]++$"

#: Names of secrets, and what is assigned to them: eight characters or more, with a digit.
_SECRET = r"(?i)(?:^|[^\p{L}])(?:access[_-]?key|api[_-]?key|auth|passwd|password|private[_-]?key|secret|token)[\"']?\s*+[:=]\s*+[\"']?$"
_SECRET_LENGTH = 8

#: Code points of the text before and after a candidate that words and punctuation are taken from.
CONTEXT = 80
#: Distinct instances of a pattern, the share of a word's occurrences, and the worth of a pattern and score of an instance that are high.
MIN_INSTANCES, MIN_RATE, MIN_WORTH, MIN_SCORE = 4, 0.25, 0.55, 0.8
#: Shortest instance that a pattern may mark; families that it needs.
MIN_LENGTH, MIN_FAMILIES = 5, 2
#: What an instance that nothing is known of counts for; quantile of the Wilson bound; most that one pattern can say.
UNKNOWN, QUANTILE, MOST = 0.25, 1.28, 0.999
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _luhn(number: Column) -> Column:
    digits = F.reverse(F.split(number, ""))
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _counts(kind: str, match: Column) -> Column:
    """Whether a match counts; one that doesn't is dropped."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _located(matches: Column, gaps: Column) -> Column:
    """Starts of ``matches``, from the text between them."""

    def starts(own: Column, sizes: Column) -> Column:
        return let(
            sums_before(F.zip_with(own, F.slice(sizes, 1, F.size(own)), lambda m, g: F.length(m) + g)),
            lambda before: F.zip_with(before, F.slice(sizes, 1, F.size(own)), lambda at, g: at + g),
        )

    return let(matches, lambda own: let(F.transform(gaps, F.length), lambda sizes: starts(own, sizes)))


def _matches(docs: DataFrame, name: str, expression: str, needed: Column) -> DataFrame:
    """Adds ``{name}_m`` (matches) and ``{name}_s`` (their starts); ``docs`` has ``text``."""
    none = F.array().cast("array<string>")
    found = docs.withColumns(
        {
            f"{name}_m": F.when(needed, F.regexp_extract_all("text", F.lit(expression), F.lit(0))).otherwise(none),
            f"{name}_g": F.when(needed, F.split("text", expression, -1)).otherwise(none),
        }
    )
    return found.withColumn(f"{name}_s", _located(F.col(f"{name}_m"), F.col(f"{name}_g"))).drop(f"{name}_g")


def _as_span(kind: str):
    def span(match: Column, start: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            _counts(kind, match).alias("ok"),
        )

    return span


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _base(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the spans of the base expressions, by kind, then start."""
    has_digit = F.col("text").rlike("[0-9]")
    per_kind = []
    out = docs.withColumn("has_digit", has_digit)
    for kind in KINDS:
        needed = (F.contains("text", F.lit("@")) if kind == "email" else F.col("has_digit")) & F.col("text").rlike(_NEEDED[kind])
        out = _matches(out, kind, _EXPRESSIONS[kind], needed)
        spans = F.zip_with(f"{kind}_m", f"{kind}_s", _as_span(kind))
        kept = F.filter(spans, lambda s: s["ok"])
        per_kind.append(
            F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        )
    return out.withColumn("base", F.concat(*per_kind).cast(SPAN)).drop(*(f"{k}_{x}" for k in KINDS for x in "ms"))


def _class(token: Column) -> Column:
    return F.when(F.contains(token, F.lit("@")), "@").when(token.rlike(r"\p{L}"), "x").otherwise("9")


def _context(before: Column, after: Column) -> Column:
    """Words and punctuation beside a candidate, from the texts between it and its neighbours."""
    left, right = F.lower(F.right(before, F.lit(CONTEXT))), F.lower(F.left(after, F.lit(CONTEXT)))
    pick = lambda text, expression: F.regexp_extract(text, expression, 1)
    tight = lambda text: F.regexp_replace(text, r"\s++", "")
    return F.struct(
        pick(left, r"([\p{L}_]++)[^\p{L}_]*+$").alias("w1"),
        pick(left, r"([\p{L}_]++)[^\p{L}_]++[\p{L}_]++[^\p{L}_]*+$").alias("w2"),
        pick(right, r"^[^\p{L}_]*+([\p{L}_]++)").alias("w3"),
        tight(pick(left, r"([^\p{L}_]*+)$")).alias("open"),
        tight(pick(right, r"^([^\p{L}_]*+)")).alias("close"),
        left.rlike(_SECRET).alias("secret"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key (of its text), base spans, and candidate tokens with their contexts."""
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    based = _base(rows)
    relevant = F.col("has_digit") | F.contains("text", F.lit("@"))
    found = based.withColumns(
        {
            "c_m": F.when(relevant, F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")),
            "c_g": F.when(relevant, F.split("text", _CANDIDATE, -1)).otherwise(F.array().cast("array<string>")),
        }
    ).withColumn("c_s", _located(F.col("c_m"), F.col("c_g")))
    tokens = F.zip_with(
        F.zip_with("c_m", "c_s", lambda m, s: F.struct(m.alias("token"), s.alias("start"))),
        F.zip_with(F.slice("c_g", 1, F.size("c_m")), F.slice("c_g", 2, F.size("c_m")), _context),
        lambda t, c: F.struct(t["token"].alias("token"), t["start"].alias("start"), c.alias("context")),
    )
    kind = "array<struct<token:string,start:int,context:struct<w1:string,w2:string,w3:string,open:string,close:string,secret:boolean>>>"
    found = found.withColumn("tokens", F.when(F.size("c_m") > 0, tokens).otherwise(F.array().cast(kind)))
    return found.select(
        "doc_id",
        F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("size")).alias("key"),
        "base",
        "tokens",
    )


def _seed(token: Column) -> Column:
    """The first kind of which the token has a base span; null if it has none."""
    said = lambda kind: F.exists(F.regexp_extract_all(token, F.lit(_EXPRESSIONS[kind]), F.lit(0)), lambda m: _counts(kind, m))
    return F.coalesce(*(F.when(token.rlike(_NEEDED[kind]) & said(kind), F.lit(kind)) for kind in KINDS))


def _rejected(token: Column) -> Column:
    """Whether a base check rejects the whole token."""
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    whole = lambda kind: token.rlike(rf"^(?:{_EXPRESSIONS[kind]})$")
    card = whole("card") & digits.between(16, 19)
    return (card & ~_counts("card", token)) | (whole("ip") & ~_counts("ip", token)) | (whole("phone") & ~_counts("phone", token))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """Candidates with the kind of their seed, if any: their cores, where these are, and their patterns."""
    one = scanned.select("doc_id", "key", F.explode("tokens").alias("o"))
    cored = one.withColumn("led", F.regexp_replace("o.token", _LEAD, ""))
    core = F.regexp_replace("led", _TAIL, "")
    start = F.col("o.start") + F.length("o.token") - F.length("led")
    cored = cored.select("doc_id", "key", "o", core.alias("instance"), start.alias("start"))
    instance, c = F.col("instance"), F.col("o.context")
    secret = c["secret"] & (F.length(instance) >= _SECRET_LENGTH) & instance.rlike("[0-9]")
    family = lambda name, word, said: F.struct(F.lit(name).alias("family"), word.alias("word"), said.alias("said"))
    words = [family(n, c[n], c[n]) for n in ("w1", "w2", "w3")]
    around = family("around", F.lit(None).cast("string"), F.concat_ws("\u0001", c["open"], c["close"]))
    patterns = F.filter(F.array(*words, around), lambda p: ~p["said"].isin("", "\u0001"))
    return cored.select(
        "doc_id",
        "key",
        "start",
        (F.col("start") + F.length(instance)).alias("end"),
        "instance",
        F.coalesce(_seed(F.col("o.token")), F.when(secret, "secret")).alias("seed"),
        _rejected(instance).alias("rejected"),
        F.transform(
            patterns,
            lambda p: F.struct(
                p["family"].alias("family"), p["word"].alias("word"), F.concat_ws("\u0001", p["family"], p["said"], _class(instance)).alias("pattern")
            ),
        ).alias("patterns"),
    )


def word_totals(docs: DataFrame) -> DataFrame:
    """word, total: how often each word occurs in ``text``."""
    words = docs.select(F.explode(F.split(F.lower(whole_text()), r"[^\p{L}_]++")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("total"))


def _edges(occurrences: DataFrame, totals: DataFrame) -> DataFrame:
    """Distinct pairs of a pattern and an instance: family, pattern, instance, seed, rejected.

    Words that stand beside candidates too seldom make no pattern.
    """
    one = occurrences.select("instance", "seed", "rejected", F.explode("patterns").alias("p")).select("instance", "seed", "rejected", "p.*")
    beside = one.filter("word is not null").groupBy("family", "word").agg(F.count("*").alias("n"))
    telling = beside.join(totals, "word").filter(F.col("n") >= MIN_RATE * F.col("total")).select("family", "word")
    kept = one.join(telling, ["family", "word"], "left_semi").unionByName(one.filter("word is null"))
    return kept.groupBy("family", "pattern", "instance").agg(F.min("seed").alias("seed"), F.max("rejected").alias("rejected"))


def _wilson(mass: Column, n: Column) -> Column:
    """Lower bound of a share of ``mass`` in ``n``."""
    p, z = mass / n, QUANTILE
    return (p + z * z / (2 * n) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def bootstrap(edges: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Patterns of high worth (family, pattern, kind, worth), and the instances that they tell (instance, kind).

    A pattern or instance that very many others share is a key of inner joins alone, whose
    large partitions Spark splits, and of sums.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_INSTANCES)
    seeds = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").cast("double").alias("mass"))
    settled = edges.groupBy("pattern").agg(F.count_if(F.col("seed").isNotNull() | F.col("rejected")).alias("settled"))
    open_ = edges.filter("seed is null")
    worth, known = None, 0
    while True:
        mass = seeds
        if worth is not None:
            doubt = F.log(1.0 - F.least("worth", F.lit(MOST)))
            heard = open_.filter("not rejected").join(worth.select("pattern", "kind", doubt.alias("doubt")), "pattern")
            whole = heard.groupBy("instance", "kind").agg(F.sum("doubt").alias("whole"))
            own = worth.select(F.col("pattern").alias("p"), F.col("kind").alias("k"), doubt.alias("own"))
            others = open_.filter("not rejected").join(whole, "instance")
            others = others.join(own, (F.col("pattern") == F.col("p")) & (F.col("kind") == F.col("k")), "left")
            # what its other patterns say of an instance
            score = 1 - F.exp(F.col("whole") - F.coalesce("own", F.lit(0.0)))
            mass = mass.unionByName(others.groupBy("pattern", "kind").agg(F.sum(score).alias("mass")))
        mass = mass.groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"), F.sum(F.lit(1)).alias("parts"))
        sized = mass.join(sizes, "pattern").join(settled, "pattern").join(seeds.select("pattern", "kind", F.col("mass").alias("sown")), ["pattern", "kind"], "left")
        heard_of = F.col("mass") - F.coalesce("sown", F.lit(0.0))
        n = F.col("settled") + heard_of + UNKNOWN * (F.col("n") - F.col("settled") - heard_of)
        valued = sized.select("pattern", "kind", _wilson(F.col("mass"), n).alias("worth")).filter(F.col("worth") >= MIN_WORTH)
        worth = steps.store(valued, "worth")
        high = worth.count()
        if high <= known:
            break
        known = high
    families = edges.select("pattern", "family").distinct()
    doubt = F.log(1.0 - F.least("worth", F.lit(MOST)))
    told = (
        open_.join(worth, "pattern").groupBy("instance", "kind")
        .agg(F.count_distinct("family").alias("families"), (1 - F.exp(F.sum(doubt))).alias("score"))
        .filter((F.col("families") >= MIN_FAMILIES) & (F.col("score") >= MIN_SCORE) & (F.length("instance") >= MIN_LENGTH))
    )
    return worth.join(families, "pattern"), told.select("instance", "kind", "score")


def find(docs: DataFrame) -> DataFrame:
    """Personal data of every row: doc_id, key, base (spans), found (spans the method adds).

    A null text counts as empty and has no spans.  Rows that repeat have the same
    spans each; a null ``doc_id`` stays null.  Other columns are left out; no rows,
    no result.  Added kinds are ``found_`` and the kind of the seeds; assigned secrets are
    ``found_secret``.
    """
    steps = Steps(docs.sparkSession, "pii")
    scanned = steps.store(scan(docs), "scan")
    occurrences = steps.store(_occurrences(scanned), "occurrences")
    edges = steps.store(_edges(occurrences, word_totals(docs.select("text"))), "edges")
    worth, told = bootstrap(edges, steps)
    unseen = occurrences.filter("seed is null").select("doc_id", "key", "start", "end", "instance", F.explode("patterns.pattern").alias("pattern"))
    by_pattern = (
        unseen.join(worth.select("pattern", "kind"), "pattern").join(told, ["instance", "kind"])
        .groupBy("doc_id", "key", "start", "end")
        .agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    )
    secrets = occurrences.filter("seed = 'secret'").select("doc_id", "key", "start", "end", F.col("seed").alias("kind"))
    marked = (
        by_pattern.unionByName(secrets)
        .select("doc_id", "key", F.struct(F.concat(F.lit("found_"), "kind").alias("kind"), "start", "end").alias("s"))
        .groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k"))
        .agg(F.sort_array(F.collect_set("s")).alias("found"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    return scanned.drop("tokens").join(marked, same, "left").select(
        "doc_id", "key", "base", F.coalesce("found", F.array().cast(SPAN)).alias("found")
    )


def _joined(spans: Column) -> Column:
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, said), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts and checksums of spans, as the query returns them."""
    return found.select(
        "doc_id",
        *(F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "found")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the first one's kind.  ``n_chars``
    is counted anew where a text changed; null texts stay null, empty ones empty; all
    rows, repeated ones too, and all columns stay, whatever their names.
    """
    doc, key, marks = (unused(n, docs.columns) for n in ("pii_doc", "pii_key", "pii_spans"))
    said = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    found = find(docs).select(
        F.col("doc_id").alias(doc),
        F.col("key").alias(key),
        F.array_sort(F.transform(F.concat("base", "found"), said)).alias(marks),
    ).filter(F.size(marks) > 0).distinct()
    text = whole_text()
    own = F.struct(F.xxhash64(text).alias("hash"), F.length(text).alias("size"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (own == F.col(key))
    # spans need a digit or an at sign: other texts, nearly all, stay where they are
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    joined = docs.filter(may).join(found, same, "left")

    def replaced(parts: Column, spans: Column, before: Column) -> Column:
        def one(s: Column, at: Column) -> Column:
            kind = F.concat(F.lit("["), F.upper(F.regexp_replace(s["kind"], "^found_", "")), F.lit("]"))
            return F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"]), kind)).otherwise(F.lit(""))

        last = F.greatest(F.element_at(before, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.zip_with(spans, before, one), ""), cut(parts, last, F.length("text")))

    ends = largest_before(F.transform(marks, lambda s: s["end"]))
    clean = let(pieces(F.col("text")), lambda parts: let(ends, lambda before: let(F.col(marks), lambda spans: replaced(parts, spans, before))))
    touched = F.col(marks).isNotNull()
    out = joined.withColumn("text", F.when(touched, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*quoted(docs.columns)).union(docs.filter(~may))
