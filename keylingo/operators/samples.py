"""Labelled training sets for the layout classifier, the classifier, and evaluation cases.

Every draw is derived from a digest of (seed, key), so runs agree at any
partitioning and SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HYPOTHESES
from ..functions import layouts as L
from ..sources.scratch import kept
from . import blocks as S
from .decide import ACTIVE

#: Characters of the classifier's input in code order, from 1.
ALPHABET = "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюяאבגדהוזחטיכךלמםנןסעפףצץקרשת0123456789.,;'[] "
CLASSES = tuple(h[0] for h in HYPOTHESES)


def draw(key: Column, seed: int, name: str) -> Column:
    """A number of 24 bits from the digest of (seed, name, key)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), key.cast("string")).cast("binary")), 1, 6), 16, 10).cast("long")


def sample_words(words: DataFrame, n: int, mode: str = "uniform", seed: int = 42) -> DataFrame:
    """(lang, word, at): n words of 2 to 19 letters of each language, uniform by digest or the first by name."""
    usable = words.select("lang", "word").where(F.length("word").between(2, 19)).distinct()
    usable = usable.withColumn("__draw", draw(F.col("word"), seed, "sample") if mode == "uniform" else F.lit(0))
    return S.numbered(usable, ("lang",), (F.asc("__draw"), F.asc("word")), "at").where(F.col("at") <= n).select("lang", "word", "at")


def make_samples(words: DataFrame, n: int, seed: int = 42, balance: float = 0.5, max_words: int = 3, focus: str | None = None, layouts=L.LAYOUTS) -> DataFrame:
    """(id, text, label): n phrases of one to ``max_words`` words, typed right or on the wrong layout.

    ``words`` is (lang, word, at), numbered from 1 in each of en, ru and he. A
    class as it is has the share ``balance``, the corrections share the rest;
    of a correction both the layout that was meant and the one that was active
    are drawn among those of its languages. ``focus`` keeps the classes that
    touch one language. Classes whose words are missing are left out; no words
    give no samples.
    """
    spark = words.sparkSession
    sizes = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    known = [h for h in HYPOTHESES if h[1] in sizes and focus in (None, h[1], h[2])]
    plain, mapped = [h for h in known if not h[2]], [h for h in known if h[2]]
    if not known:
        return spark.createDataFrame([], "id long, text string, label string")
    ids = F.col("id")

    def one_of(options, name: str) -> Column:
        return F.element_at(F.array(*(F.lit(o) for o in options)), (draw(ids, seed, name) % len(options) + 1).cast("int"))

    of_plain, of_mapped = (one_of([h[0] for h in group], "which") if group else None for group in (plain, mapped))
    if plain and mapped:
        label = F.when(draw(ids, seed, "class") / F.lit(float(1 << 24)) < balance, of_plain).otherwise(of_mapped)
    else:
        label = of_plain if plain else of_mapped
    target, size, meant, typed_on = (F.lit(None) for _ in range(4))
    own = lambda lang: [x for x, of, _ in layouts if of == lang]
    for h, t, s, _ in known:
        here = F.col("label") == h
        target, size = F.when(here, t).otherwise(target), F.when(here, sizes[t]).otherwise(size)
        meant = F.when(here, one_of(own(t), "meant")).otherwise(meant)
        typed_on = F.when(here, one_of(own(s), "typed") if s else F.lit(None)).otherwise(typed_on)
    cases = spark.range(n).withColumn("label", label).select("id", "label", target.alias("lang"), size.cast("long").alias("size"), meant.alias("meant"), typed_on.alias("typed_on"))
    parts = cases.withColumn("part", F.explode(F.sequence(F.lit(1), (draw(ids, seed, "length") % max_words + 1).cast("int"))))
    picks = parts.withColumn("at", draw(F.concat_ws("/", "id", "part"), seed, "word") % F.col("size") + 1).join(words.select("lang", "at", "word"), ["lang", "at"])
    whole = picks.groupBy("id", "label", "meant", "typed_on").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    text = F.col("phrase")
    for a, of, _ in layouts:
        for b, on, _ in layouts:
            if of != on:
                text = F.when((F.col("meant") == a) & (F.col("typed_on") == b), L.convert(F.col("phrase"), a, b)).otherwise(text)
    return whole.select("id", text.alias("text"), "label")


#: Letters of the three languages in both cases, and their neighbours by code point.
_LETTERS = "".join(c for a, b in (("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("א", "ת")) for c in map(chr, range(ord(a), ord(b) + 1)))
AFTER, BEFORE = ("".join(chr(ord(c) + n) for c in _LETTERS) for n in (1, -1))


def _other_case(c: Column) -> Column:
    """The character in its other case, if that is one character too."""
    return F.when(F.length(F.upper(c)) != 1, c).when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))


def augment_samples(samples: DataFrame, p: float = 0.15, seed: int = 42) -> DataFrame:
    """``samples`` with a share ``p`` of the texts changed in one of five ways, drawn evenly.

    A letter in another case or replaced by a neighbour, three characters in ten
    in another case, two neighbours swapped, one character dropped (of three or
    more), or one doubled. Texts of one character stay.
    """
    hit = draw(F.col("id"), seed, "augment") / F.lit(float(1 << 24)) < p
    kind = draw(F.col("id"), seed, "kind") % 5
    way = draw(F.col("id"), seed, "way") % 4  # case in two of four, else a neighbour
    at = (draw(F.col("id"), seed, "place") % F.greatest(F.length("text") - 1, F.lit(1)) + 1).cast("int")
    t = F.col("text")
    head, one, two, tail = F.substring(t, F.lit(1), at - 1), F.substring(t, at, F.lit(1)), F.substring(t, at + 1, F.lit(1)), F.substring(t, at + 2, F.length(t))
    wrong = F.when(way < 2, _other_case(one)).when(way == 2, F.translate(one, _LETTERS, AFTER)).otherwise(F.translate(one, _LETTERS, BEFORE))
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    cased = F.array_join(F.transform(chars, lambda c, n: F.when(draw(F.concat_ws("/", "id", n), seed, "case") % 10 < 3, _other_case(c)).otherwise(c)), "")
    made = F.when(kind == 0, F.concat(head, wrong, two, tail)).when(kind == 1, cased).when(kind == 2, F.concat(head, two, one, tail))
    made = made.when(kind == 3, F.when(F.length(t) > 2, F.concat(head, two, tail)).otherwise(t)).otherwise(F.concat(head, one, one, two, tail))
    return samples.withColumn("text", F.when(hit & (F.length("text") >= 2), made).otherwise(t))


def split_samples(samples: DataFrame, share: float = 0.9, seed: int = 42, key: str = "id") -> DataFrame:
    """``samples`` with part: train or validation, by digest."""
    return samples.withColumn("part", F.when(draw(F.col(key), seed, "split") / F.lit(float(1 << 24)) < share, "train").otherwise("validation"))


def encode_samples(samples: DataFrame, width: int = 20) -> DataFrame:
    """``samples`` with codes (a list of ``width`` character codes, 0 for unknown and padding), cls (the label's number) and unknown."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    cls = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col("label")) - 1
    cut = F.slice(F.concat(codes, F.array_repeat(F.lit(0), width)), 1, width)
    return samples.withColumn("codes", cut).withColumn("cls", cls).withColumn("unknown", F.size(F.filter(codes, lambda c: c == 0)).cast("long"))


def unknown_rates(encoded: DataFrame) -> DataFrame:
    """(label, samples, chars, unknown, rate): how many characters of each label's texts the classifier doesn't know; empty texts have none."""
    out = encoded.groupBy("label").agg(F.count("*").alias("samples"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"))
    return out.withColumn("rate", F.when(F.col("chars") > 0, F.col("unknown") / F.col("chars")).otherwise(0.0))


def _grams(longest: int):
    """A pipeline stage that adds ``grams``: a text's character 1- to ``longest``-grams in lower case."""
    from pyspark.ml.feature import SQLTransformer

    run = "if(length(lower(text)) >= {n}, transform(sequence(1, greatest(length(lower(text)) - {n} + 1, 1)), i -> substring(lower(text), i, {n})), array())"
    return SQLTransformer(statement=f"SELECT *, flatten(array({', '.join(run.format(n=n) for n in range(1, longest + 1))})) AS grams FROM __THIS__")


def _features(samples: DataFrame, longest: int, vocabulary: int, least: int):
    """Fitted stages from text to features, each a gram that ``least`` samples have, the most frequent ones; and the samples' (cls, features) as a table."""
    from pyspark.ml.feature import CountVectorizer

    cutter = _grams(longest)
    cut = cutter.transform(samples.where("cls >= 0").select("text", F.col("cls").cast("double").alias("cls")))
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, minDF=float(least)).fit(cut)
    return [cutter, counter], kept(counter.transform(cut).select("cls", "features"), "features")


def _regression(iterations: int, strength: float):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol="cls", featuresCol="features", family="multinomial", maxIter=iterations, regParam=strength)


def train_classifier(samples: DataFrame, vocabulary: int = 1 << 14, iterations: int = 30, longest: int = 5, strength: float = 1e-3, least: int = 2):
    """A nine-class text classifier on character 1- to 5-grams: a Spark ML pipeline of the frequent grams and multinomial logistic regression."""
    from pyspark.ml import PipelineModel

    stages, rows = _features(samples, longest, vocabulary, least)
    return PipelineModel([*stages, _regression(iterations, strength).fit(rows)])


def predict_classes(model, df: DataFrame) -> DataFrame:
    """``df`` with predicted and confidence."""
    from pyspark.ml.functions import vector_to_array

    made = model.transform(df).withColumn("__p", vector_to_array("probability"))
    labels = F.array(*(F.lit(c) for c in CLASSES))
    return made.select(*df.columns, F.element_at(labels, F.col("prediction").cast("int") + 1).alias("predicted"), F.array_max("__p").alias("confidence"))


def select_best(train: DataFrame, validation: DataFrame, grid=((1e-1, 10), (1e-3, 30)), vocabulary: int = 1 << 14, longest: int = 5, least: int = 2, parallelism: int = 2) -> DataFrame:
    """(strength, iterations, accuracy, best) of each setting by its accuracy on validation rows.

    Features are made once into tables; settings are fitted side by side on them.
    """
    from multiprocessing.pool import ThreadPool

    stages, rows = _features(train, longest, vocabulary, least)
    cut = stages[0].transform(validation.where("cls >= 0").select("text", F.col("cls").cast("double").alias("cls")))
    held = kept(stages[1].transform(cut).select("cls", "features"), "validation")
    plain = _regression(*reversed(grid[0]))
    models = plain.fitMultiple(rows, [{plain.regParam: strength, plain.maxIter: n} for strength, n in grid])

    def judged(_) -> tuple[int, float]:
        at, model = next(models)
        return at, model.transform(held).agg(F.avg((F.col("prediction") == F.col("cls")).cast("double"))).first()[0]

    with ThreadPool(min(parallelism, len(grid))) as pool:
        scores = dict(pool.imap_unordered(judged, range(len(grid))))
    top = max(s for s in scores.values())
    return train.sparkSession.createDataFrame([(*grid[at], s, s == top) for at, s in sorted(scores.items())], "strength double, iterations int, accuracy double, best boolean")


def blend_models(a: DataFrame, b: DataFrame, wa: float = 0.6, wb: float = 0.4, key: str = "id", col: str = "scores") -> DataFrame:
    """(key, scores): sigmoids of two models' scores, weighted."""
    both = a.select(key, F.col(col).alias("x")).join(b.select(key, F.col(col).alias("y")), key)
    sigmoid = lambda v: 1 / (1 + F.exp(-v))
    return both.select(key, F.zip_with("x", "y", lambda x, y: wa * sigmoid(x) + wb * sigmoid(y)).alias(col))


def synthetic_cases(words: DataFrame, typed_on=("us", "ru", "he"), seed: int = 42) -> DataFrame:
    """(word, kind, typed_on, intended, typed, expected): evaluation cases from (word, rank); cases that typing doesn't change keep ``en``."""
    kind = F.when(F.length("word") <= 3, "short").when(F.length("word") <= 7, "medium").otherwise("long")
    punctuated = draw(F.col("word"), seed, "mark") % 10 < 2
    intended = F.when(punctuated, F.concat("word", F.lit("!"))).otherwise(F.col("word"))
    options = F.array(*(F.struct(F.lit(x).alias("typed_on"), (F.col("intended") if x == "us" else L.convert(F.col("intended"), "us", x)).alias("typed"), F.lit("en" if x == "us" else f"en_from_{x}").alias("expected")) for x in typed_on))
    every = words.select("word", kind.alias("kind"), intended.alias("intended")).withColumn("o", F.explode(options)).select("word", "kind", "intended", "o.*")
    return every.where((F.col("typed_on") == "us") | (F.col("typed") != F.col("intended")))


#: Kinds of evaluation cases and their shares of a hundred.
KINDS = (("short", 20), ("medium", 20), ("informal", 15), ("phrase", 15), ("mixed", 12), ("punctuation", 10), ("informal_punctuation", 8))
#: Letters of the drawn words of each kind, by slot; 0 to 0 is an informal word.
SLOTS = {
    "short": ((2, 3),), "medium": ((4, 8),), "informal": ((0, 0),), "phrase": ((2, 10),) * 6, "mixed": ((0, 0), (3, 8)),
    "punctuation": ((2, 8), (2, 10), (2, 10)), "informal_punctuation": ((0, 0), (0, 0)),
}
#: Shares of a hundred of the bands of ranks, and the ranks of each: (band, share, first, last).
BANDS = (("head", 50, 1, 4000), ("middle", 35, 20_001, 40_000), ("tail", 15, 150_001, None))


def quotas(n: int, shares=KINDS) -> dict[str, int]:
    """``n`` dealt by shares, whole numbers by the largest remainder, ties to the first."""
    whole = sum(s for _, s in shares)
    out = {name: n * s // whole for name, s in shares}
    rest = sorted(range(len(shares)), key=lambda i: (-(n * shares[i][1] % whole), i))[: n - sum(out.values())]
    for i in rest:
        out[shares[i][0]] += 1
    return out


def evaluation_cases(words: DataFrame, informal: DataFrame, n_per_lang: int = 300, seed: int = 42, langs=("en", "ru", "he"), layouts=ACTIVE) -> DataFrame:
    """(lang, id, kind, typed_on, intended, typed, expected): stratified cases from (lang, word, rank) and informal (lang, word).

    Each language has ``n_per_lang`` intended texts, by kind in exact quotas; the
    words in them are drawn by band of rank and number of letters, half of them
    from the head, in exact quotas too. Every text is typed on each language's
    layout; what typing doesn't change is left out unless it is meant so. A band
    that a short lexicon doesn't have is the whole lexicon; where no word has the
    letters, any of the head is taken. A stratum gives as many words as it has to,
    the first by digest, and begins again when it has fewer. A language without
    words, or without informal ones where they are asked for, has no such texts.
    """
    spark = words.sparkSession
    upto, kind = 0, F.when(F.lit(False), "")
    for name, n in quotas(n_per_lang).items():
        upto += n
        kind = kind.when(F.col("id") < upto, name)
    cases = spark.range(n_per_lang).withColumn("kind", kind).withColumn("lang", F.explode(F.array(*map(F.lit, langs))))
    key = F.concat_ws("/", "lang", "id", "slot")
    slots = F.lit(None)
    for name, ranges in SLOTS.items():
        each = F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(a).alias("least"), F.lit(b).alias("most")) for i, (a, b) in enumerate(ranges)))
        slots = F.when(F.col("kind") == name, each).otherwise(slots)
    size = F.when(F.col("kind") == "phrase", draw(F.concat_ws("/", "lang", "id"), seed, "length") % 5 + 2).otherwise(6).cast("int")
    picks = cases.select("lang", "id", "kind", F.explode(F.slice(slots, F.lit(1), size)).alias("s")).select("lang", "id", "kind", "s.*")

    # exact quotas of bands within (language, letters); informal words have one band
    stratum = Window.partitionBy("lang", "least", "most")
    picks = picks.withColumn("p", F.row_number().over(stratum.orderBy(draw(key, seed, "band"), "id", "slot"))).withColumn("m", F.count("*").over(stratum))
    (head, head_share, *_), (middle, middle_share, *_), (tail, *_) = BANDS
    band = F.when(F.col("most") == 0, "informal").when(F.col("p") * 100 <= F.col("m") * head_share + 50, head).when(F.col("p") * 100 <= F.col("m") * (head_share + middle_share) + 50, middle).otherwise(tail)
    picks = picks.withColumn("band", band).withColumn("j", F.row_number().over(Window.partitionBy("lang", "least", "most", "band").orderBy(draw(key, seed, "pick"), "id", "slot")))

    # words of each stratum: as many as are picked at most, so that a task keeps no more than that of a stratum
    ranges = sorted({r for slots_ in SLOTS.values() for r in slots_ if r != (0, 0)})
    sizes = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    options = []
    for name, _, first, last in BANDS:
        there = F.lit(False)
        for x in langs:
            here = F.col("lang") == x
            there = there | (here & (F.col("rank").between(first, last or 1 << 62) if sizes.get(x, 0) >= first else F.lit(True)))
        options += [F.when(there & F.length("word").between(a, b), F.struct(F.lit(name).alias("band"), F.lit(a).alias("least"), F.lit(b).alias("most"))) for a, b in ranges]
        if name == head:
            options.append(F.when(there, F.struct(F.lit("any").alias("band"), F.lit(0).alias("least"), F.lit(0).alias("most"))))
    member = F.explode(F.filter(F.array(*options), lambda o: o.isNotNull()))
    pools = words.where(F.col("lang").isin(*langs)).select("lang", "word", member.alias("o")).select("lang", "word", "o.*")
    own = informal.where(F.col("lang").isin(*langs) & F.col("word").isNotNull()).select("lang", "word").distinct()
    pools = pools.unionByName(own.select("lang", "word", F.lit("informal").alias("band"), F.lit(0).alias("least"), F.lit(0).alias("most")))
    most = n_per_lang * max(map(len, SLOTS.values()))
    first_by_digest = Window.partitionBy("lang", "band", "least", "most").orderBy(draw(F.col("word"), seed, "word"), "word")
    pools = pools.withColumn("j", F.row_number().over(first_by_digest)).where(F.col("j") <= most)
    pools = kept(pools.withColumn("n", F.count("*").over(Window.partitionBy("lang", "band", "least", "most"))), "pools")

    strata = pools.where("j = 1").select("lang", "band", "least", "most", "n")
    whole_head = strata.where("band = 'any'").select("lang", F.col("n").alias("n_any"))
    placed = picks.join(strata, ["lang", "band", "least", "most"], "left").join(whole_head, "lang", "left")
    found = F.col("n").isNotNull() | (F.col("band") == "informal")
    placed = placed.select(
        "lang", "id", "kind", "slot", F.when(found, F.col("band")).otherwise("any").alias("band"), F.when(found, F.col("least")).otherwise(0).alias("least"),
        F.when(found, F.col("most")).otherwise(0).alias("most"), ((F.col("j") - 1) % F.when(found, F.col("n")).otherwise(F.col("n_any")) + 1).alias("j"),
    )
    drawn = placed.join(pools.drop("n"), ["lang", "band", "least", "most", "j"], "left")
    whole = drawn.groupBy("lang", "id", "kind").agg(F.array_sort(F.collect_list(F.struct("slot", "word"))).alias("parts"), F.count_if(F.col("word").isNull()).alias("missing")).where("missing = 0")
    a, b, c = (F.get("parts", F.lit(i))["word"] for i in range(3))
    roll = lambda name, sides: draw(F.concat_ws("/", "lang", "id"), seed, name) % sides

    def one_of(name: str, *texts) -> Column:
        out = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in texts[-1]))
        for i, parts in reversed(list(enumerate(texts[:-1]))):
            out = F.when(roll(name, len(texts)) == i, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise(out)
        return out

    intended = F.when(F.col("kind").isin("short", "medium", "informal"), a).when(F.col("kind") == "phrase", F.array_join(F.transform("parts", lambda x: x["word"]), " "))
    intended = intended.when(F.col("kind") == "mixed", one_of("order", (a, " ", b), (b, " ", a)))
    intended = intended.when(F.col("kind") == "punctuation", one_of("mark", (a, ", ", b), (a, ",", b), (a, " / ", b), ("(", a, ") ", b), (a, " ", b, "! ", c), (a, " ", b)))
    intended = intended.otherwise(one_of("style", (a, "!!!"), (a, "???"), (a, ", ", b), (a, "... ", b), (a, " ", b, "!")))
    typed = []
    for x in langs:
        text = F.lit(None).cast("string")
        for y in langs:
            text = F.when(F.col("lang") == y, F.col("intended") if x == y else L.convert(F.col("intended"), layouts[y], layouts[x])).otherwise(text)
        expected = F.when(F.col("lang") == x, F.lit(x)).otherwise(F.concat("lang", F.lit(f"_from_{x}")))
        typed.append(F.struct(F.lit(x).alias("typed_on"), text.alias("typed"), expected.alias("expected")))
    every = whole.withColumn("intended", intended).select("lang", "id", "kind", "intended", F.explode(F.array(*typed)).alias("o")).select("lang", "id", "kind", "intended", "o.*")
    return every.where((F.col("typed_on") == F.col("lang")) | (F.col("typed") != F.col("intended"))).select("lang", "id", "kind", "typed_on", "intended", "typed", "expected")
