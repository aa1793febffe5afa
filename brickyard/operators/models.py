"""Transparent extraction models: pattern precision and token frequency, trained and applied as DataFrames.

Training is aggregation; applying is expressions within a row, so it shuffles nothing. A model is a
handful of numbers for each pattern, bound by the fixed list of patterns, and enters the plan as
literals. The address model's dictionaries grow with the data; they stay tables and are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.functions import fixed
from brickyard.functions.text import clean, find_all, has, let, normal_address, small_int, title_words, tokens, url_address


def _concat(arrays: list[Column]) -> Column:
    return F.concat(*arrays)


def _snippet(text: Column, m: Column, before: int, after: int) -> Column:
    start = F.greatest(m["start"] - before, F.lit(0))
    return F.substring(text, start + 1, m["start"] + F.length(m["text"]) + after - start)


def room_label(value: Column) -> Column:
    """1 to 4, "5+" for five and more, "" for no label."""
    v = clean(value)
    return F.when(v.isin("1", "2", "3", "4"), v).when(v.isin("5", "5+"), "5+").otherwise("")


def _room_value(name: str, m: Column) -> Column:
    return F.lit(fixed.ROOM_WORDS[name]) if name in fixed.ROOM_WORDS else room_label(m["g1"])


def _room_matches(text: Column, name: str, pattern: str) -> Column:
    return find_all(text, pattern, 0 if name in fixed.ROOM_WORDS else 1)


def room_candidates(text: Column) -> Column:
    """(pattern, rooms) of every match of every room pattern in a cleaned text."""
    def of(name: str, pattern: str) -> Column:
        return F.transform(_room_matches(text, name, pattern), lambda m: F.struct(F.lit(name).alias("pattern"), _room_value(name, m).alias("rooms")))

    return F.filter(_concat([of(*p) for p in fixed.ROOM_PATTERNS.items()]), lambda c: c["rooms"] != "")


def fit_rooms(rows: DataFrame, text: Column, label: Column) -> DataFrame:
    """Per pattern its hits (a value counts once in a row), how many are right, and precision to four places (half to even)."""
    labelled = rows.select(room_label(label).alias("label"), clean(text).alias("text")).where("label <> ''")
    hits = labelled.select("label", F.explode(F.array_distinct(room_candidates(F.col("text")))).alias("c"))
    g = hits.groupBy("c.pattern").agg(F.count("*").alias("hits"), F.count_if(F.col("c.rooms") == F.col("label")).alias("correct"))
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, fixed.ROOM_PATTERNS))).alias("pattern"))
    zero = F.lit(0).cast("long")
    return F.broadcast(every).join(g, "pattern", "left").select(
        "pattern", F.coalesce("hits", zero).alias("hits"), F.coalesce("correct", zero).alias("correct"), F.coalesce(F.bround(F.col("correct") / F.col("hits"), 4), F.lit(0.0)).alias("precision")
    )


def label_counts(rows: DataFrame, label: Column) -> DataFrame:
    """How often each label occurs; blanks are left out."""
    return rows.select(label.alias("label")).where("label is not null and label <> ''").groupBy("label").agg(F.count("*").alias("n"))


def best_rooms(text: Column, url: Column, precision: dict[str, float]) -> Column:
    """(rooms, score) by weighted vote over a row's candidates; null where there are none.

    The winner has the largest sum, the first seen on ties; its score is the larger of that sum
    and its best candidate's score.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[._/?=&-]+", " ")
    return let(F.struct(clean(text).alias("text"), plain.alias("url")), lambda row: _vote(row["text"], row["url"], precision))


def _vote(text: Column, plain: Column, precision: dict[str, float]) -> Column:
    def of(name: str, pattern: str) -> Column:
        base = 1.0 + precision.get(name, 0.0) + (0.0 if name in fixed.ROOM_PLAIN else 0.5) + (0.7 if name == "studio" else 0.0)

        def one(m: Column) -> Column:
            def bonus(near: Column) -> Column:
                sale, size, storey = r"(?:квартира|кв\.?|продаж|продам|продається|продается)", r"(?:м²|м2|кв\.?\s*м)", r"(?:поверх|этаж)"
                return sum((F.when(has(near, p), x).otherwise(0.0) for p, x in ((sale, 0.4), (size, 0.2), (storey, 0.1))), F.lit(base))

            return F.struct(_room_value(name, m).alias("rooms"), let(clean(_snippet(text, m, 24, 36)), bonus).alias("score"))

        return F.transform(_room_matches(text, name, pattern), one)

    def of_url(name: str, pattern: str) -> Column:
        value = (lambda m: F.lit("1")) if name == "url_studio" else (lambda m: room_label(m["g1"]))
        return F.transform(find_all(plain, pattern, 0 if name == "url_studio" else 1), lambda m: F.struct(value(m).alias("rooms"), F.lit(1.4).alias("score")))

    every = [of(*p) for p in fixed.ROOM_PATTERNS.items()] + [of_url(*p) for p in fixed.ROOM_URL_PATTERNS.items()]
    candidates = F.filter(_concat(every), lambda c: c["rooms"] != "")

    def winner(c: Column) -> Column:
        def vote(value: Column, k: Column) -> Column:
            own = F.filter(c, lambda x: x["rooms"] == value)
            total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["score"])
            return F.struct(total.alias("total"), (-k).alias("turn"), value.alias("rooms"), F.array_max(F.transform(own, lambda x: x["score"])).alias("best"))

        win = F.array_max(F.transform(F.array_distinct(F.transform(c, lambda x: x["rooms"])), vote))
        return let(win, lambda w: F.when(w.isNotNull(), F.struct(w["rooms"].alias("rooms"), F.greatest(w["total"], w["best"]).alias("score"))))

    return let(candidates, winner)


def _floor_pair(name: str, m: Column) -> Column:
    if name in fixed.FLOOR_FIRST:
        return F.struct(F.lit(1).alias("floor"), F.lit(None).cast("int").alias("floors"))
    second = small_int(m["g2"]) if name in fixed.FLOOR_PAIRS else F.lit(None).cast("int")
    none = F.lit(None).cast("int")
    both = F.struct(small_int(m["g1"]).alias("floor"), second.alias("floors"))
    return let(both, lambda x: F.when(x["floor"] > x["floors"], F.struct(none.alias("floor"), none.alias("floors"))).otherwise(x))


def _floor_patterns() -> dict[str, str]:
    """Those that can give a floor; the ones for a middle floor never do."""
    return {n: p for n, p in fixed.FLOOR_PATTERNS.items() if not n.startswith("middle")}


def _floor_matches(text: Column, name: str, pattern: str) -> Column:
    return find_all(text, pattern, 2 if name in fixed.FLOOR_PAIRS else 0 if name in fixed.FLOOR_FIRST else 1)


def floor_candidates(text: Column) -> Column:
    """(pattern, floor, floors) of every match that gives a floor."""
    def of(name: str, pattern: str) -> Column:
        def one(m: Column) -> Column:
            return let(_floor_pair(name, m), lambda x: F.struct(F.lit(name).alias("pattern"), x["floor"].alias("floor"), x["floors"].alias("floors")))

        return F.transform(_floor_matches(text, name, pattern), one)

    return F.filter(_concat([of(*p) for p in _floor_patterns().items()]), lambda c: c["floor"].isNotNull())


def fit_floors(rows: DataFrame, text: Column, floor: Column, floors: Column) -> DataFrame:
    """Per pattern its hits (each match counts) and how many floors and houses are right, with precisions."""
    labelled = rows.select(small_int(floor).alias("f"), small_int(floors).alias("t"), clean(text).alias("text")).where("f is not null")
    hits = labelled.select("f", "t", F.explode(floor_candidates(F.col("text"))).alias("c"))
    g = hits.groupBy("c.pattern").agg(
        F.count("*").alias("hits"), F.count_if(F.col("c.floor") == F.col("f")).alias("correct_floor"), F.count_if(F.col("c.floors") == F.col("t")).alias("correct_total")
    )
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, fixed.FLOOR_PATTERNS))).alias("pattern"))
    zero = F.lit(0).cast("long")

    def share(c: str) -> Column:
        return F.coalesce(F.bround(F.col(c) / F.col("hits"), 4), F.lit(0.0))

    return F.broadcast(every).join(g, "pattern", "left").select(
        "pattern", *[F.coalesce(c, zero).alias(c) for c in ("hits", "correct_floor", "correct_total")], share("correct_floor").alias("floor_precision"), share("correct_total").alias("total_precision")
    )


def best_floor(text: Column, precision: dict[str, float]) -> Column:
    """(floor, floors, score) of a row's best candidate: with a number of floors first, then by score, the first on ties."""
    return let(clean(text), lambda t: _best_floor(t, precision))


def _best_floor(text: Column, precision: dict[str, float]) -> Column:
    def of(name: str, pattern: str) -> Column:
        base = 1.0 + precision.get(name, 0.0) + (0.4 if name in fixed.FLOOR_PAIRS else 0.0)

        def one(m: Column) -> Column:
            def scored(x: Column) -> Column:
                pair, near = x["pair"], x["near"]
                storey, size = r"(?:поверх|поверсі|этаж|этаже)", r"(?:кімнат|комнат|м²|м2|кв\.?\s*м)"
                score = F.lit(base) + F.when(pair["floors"].isNotNull(), 0.7).otherwise(0.0) + F.when(has(near, storey), 0.4).otherwise(0.0) + F.when(has(near, size), 0.2).otherwise(0.0)
                return F.struct(pair["floors"].isNotNull().alias("paired"), score.alias("score"), pair["floor"].alias("floor"), pair["floors"].alias("floors"))

            return let(F.struct(_floor_pair(name, m).alias("pair"), clean(_snippet(text, m, 36, 48)).alias("near")), scored)

        return F.transform(_floor_matches(text, name, pattern), one)

    found = F.filter(_concat([of(*p) for p in _floor_patterns().items()]), lambda c: c["floor"].isNotNull())
    ranked = F.transform(found, lambda c, k: F.struct(c["paired"].alias("paired"), c["score"].alias("score"), (-k).alias("turn"), c["floor"].alias("floor"), c["floors"].alias("floors")))
    return let(F.array_max(ranked), lambda w: F.when(w.isNotNull(), F.struct(w["floor"].alias("floor"), w["floors"].alias("floors"), w["score"].alias("score"))))


def fit_addresses(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables of the address model from rows (ord, source, city, address, text).

    ``addresses`` and ``tokens`` by frequency, the first seen on ties; ``city_tokens`` by city;
    ``known_ratio`` by source; ``markers`` seen near an address in its text. Addresses of sources
    that guess them count only with a clear marker.
    """
    a = rows.withColumn("address", F.btrim(clean(F.col("address")), F.lit(" ,.;:-")))
    low = F.lower("address")
    clear = reduce(lambda x, y: x | y, [F.contains(low, F.lit(m)) for m in fixed.CLEAR_MARKERS])
    used = a.where((F.col("address") != "") & (~F.col("source").isin(*fixed.WEAK_SOURCES) | clear))
    addresses = used.groupBy("address").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    generic = F.array(*map(F.lit, fixed.GENERIC_TOKENS))
    words = used.select("ord", "city", F.posexplode(tokens(F.col("address"))).alias("pos", "token")).where(~F.array_contains(generic, F.col("token")))
    seen = F.min(F.struct("ord", "pos")).alias("first")
    total = rows.groupBy("source").agg(F.count("*").alias("total"))
    known = used.groupBy("source").agg(F.count("*").alias("known"))
    at = F.instr(F.lower("text"), low)
    start = F.greatest(at - 24, F.lit(1))
    window = F.substring(F.lower("text"), start, at - start + F.length("address") + 24)
    markers = used.where(at > 0).select("ord", window.alias("w"), F.posexplode(F.array(*map(F.lit, fixed.ADDRESS_MARKERS))).alias("pos", "marker")).where(F.contains("w", "marker"))
    return {
        "addresses": addresses, "tokens": words.groupBy("token").agg(F.count("*").alias("n"), seen), "city_tokens": words.where("city <> ''").groupBy("city", "token").agg(F.count("*").alias("n"), seen),
        "known_ratio": total.join(known, "source", "left").select("source", F.bround(F.coalesce("known", F.lit(0)) / F.col("total"), 4).alias("ratio")),
        "markers": markers.groupBy("marker").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first")),
    }


#: Characters of known addresses that a task searches for at once, as one automaton of about 100 bytes a character.
AUTOMATON_CHARACTERS = 1_000_000


def _search(entries: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (ord, low) to (ord, k): each entry that a text contains, once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for k, (look, *_) in enumerate(entries.value):
            machine.add_word(look, (*machine.get(look, ()), k))
        if not len(machine):
            return
        machine.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, low in enumerate(batch.column(1).to_pylist()):
                hits = {k for _, some in machine.iter(low or "") for k in some}
                at += [i] * len(hits)
                found += sorted(hits)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            rows = [entries.value[k] for k in found]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[j] for r in rows], t) for j, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64())))], names=["ord", "address", "n", "first"])

    return work


def _holding(rows: DataFrame, known: DataFrame, room: int = AUTOMATON_CHARACTERS) -> DataFrame:
    """(ord, address, n, first): rows (ord, text) with each known address that the text contains, without regard to case.

    The known addresses are split by a hash into parts of about ``room`` characters, each sent to the tasks as one automaton, which
    reads a text once for all of them. Texts stay where they are; they are read once for each part.
    """
    spark = rows.sparkSession
    entries = known.select(F.lower("address").alias("look"), "address", F.col("n").cast("long").alias("n"), F.col("first").cast("long").alias("first"))
    size = entries.agg(F.sum(F.length("look"))).first()[0] or 0
    parts = max(1, -(-size // room))
    low = rows.select(F.col("ord"), F.lower("text").alias("low")).where("low is not null")
    schema = f"ord {rows.schema['ord'].dataType.simpleString()}, address string, n long, first long"

    def one(k: int) -> DataFrame:
        some = entries.where(F.pmod(F.xxhash64("address"), F.lit(parts)) == k).toLocalIterator() if parts > 1 else entries.toLocalIterator()
        return low.mapInArrow(_search(spark.sparkContext.broadcast([tuple(r) for r in some])), schema)

    return reduce(DataFrame.union, [one(k) for k in range(parts)])


def address_candidates(rows: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """(ord, turn, value, kind, score) of each row's candidate addresses from rows (ord, source, city, url, text).

    Patterns in the description, known addresses that it contains, the url, and known tokens of the
    city, in that order. Known addresses are found by an automaton, tokens met by an equi-join on (city, token).
    """
    text = F.col("text")
    patterned = F.filter(
        _concat([F.transform(find_all(text, p, 1), lambda m: title_words(normal_address(m["g1"]))) for p in fixed.ADDRESS_PATTERNS]), lambda v: v != ""
    )
    one = rows.select("ord", F.posexplode(patterned).alias("turn", "value")).select("ord", F.struct(F.lit(0), F.col("turn").cast("long")).alias("turn"), "value", F.lit("description_regex").alias("kind"), F.lit(1.8).alias("score"))
    order = F.struct(F.lit(1), F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("n"), "first")).cast("long"))
    known = model["addresses"].where(F.length("address") >= 5).select("address", "n", "first")
    two = _holding(rows, known).select("ord", order.alias("turn"), F.col("address").alias("value"), F.lit("known_address").alias("kind"), F.lit(2.6).alias("score"))
    three = rows.select("ord", url_address(F.col("url")).alias("value")).where("value <> ''").select("ord", F.struct(F.lit(2), F.lit(0).cast("long")).alias("turn"), "value", F.lit("url_slug").alias("kind"), F.lit(1.5).alias("score"))
    spread = rows.select("ord", "city", F.explode(F.array_distinct(tokens(text))).alias("token")).where(F.length("token") >= 5)
    met = spread.join(model["city_tokens"], ["city", "token"])
    rank = F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("n"), "first"))
    four = met.withColumn("k", rank).where("k <= 8").select("ord", F.struct(F.lit(3), F.col("k").cast("long")).alias("turn"), title_words(F.col("token")).alias("value"), F.lit("learned_token").alias("kind"), F.lit(1.1).alias("score"))
    names = ["ord", "struct(turn.*) as turn", "value", "kind", "score"]
    return reduce(DataFrame.union, [x.select("ord", F.struct(F.col("turn").getField(x.schema["turn"].dataType.names[0]).alias("a"), F.col("turn").getField(x.schema["turn"].dataType.names[1]).alias("b")).alias("turn"), *names[2:]) for x in (one, two, three, four)])


def score_addresses(candidates: DataFrame, rows: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """Candidates with their normal value and final score; rejected ones are gone.

    A candidate's words meet the model's tokens by equi-joins, once each, and are counted back.
    """
    def fine(v: Column) -> Column:
        return ~F.lower(v).isin(*fixed.BAD_ADDRESSES) & ~F.lower(v).rlike(r"идеальная|ідеальная|сегодня|сьогодні|\d{1,2}:\d{2}") & (v != "")

    # An array of one, so that the steps of the normal form are taken once, not again in each condition pushed below them.
    once = F.filter(F.transform(F.array("value"), normal_address), fine)
    c = candidates.select("ord", "turn", "kind", "score", F.explode(once).alias("value")).join(rows.select("ord", "source", "city"), "ord")
    c = c.withColumn("low", F.lower("value")).withColumn("words", F.array_distinct(tokens(F.col("value"))))
    spread = c.select("ord", "turn", "city", F.explode("words").alias("token"))
    token = model["tokens"].select("token", F.lit(1).alias("in_all"))
    local = model["city_tokens"].select("city", "token", F.lit(1).alias("in_city"))
    met = spread.join(token, "token", "left").join(local, ["city", "token"], "left").groupBy("ord", "turn").agg(F.count("in_all").alias("k"), F.count("in_city").alias("l"))
    clear = reduce(lambda x, y: x | y, [F.contains("low", F.lit(m)) for m in ("вул", "ул", "просп", "пров", "ж/м", "жк")])
    dotted = reduce(lambda x, y: x | y, [F.contains("low", F.lit(m)) for m in ("вул.", "ул.", "просп.", "пров.", "ж/м", "жк")])
    marked = dotted | F.arrays_overlap("words", F.array(*map(F.lit, fixed.SCORED_MARKERS)))
    n = lambda column: F.coalesce(column, F.lit(0)).cast("double")
    score = (
        F.col("score") - F.when((F.size("words") == 1) & ~clear, 0.8).otherwise(0.0) + F.least(F.lit(1.5), n("k") * 0.35) + F.least(F.lit(1.0), n("l") * 0.30)
        + F.when(marked, 1.0).otherwise(0.0) + F.when(F.contains("value", F.lit("/")), 0.4).otherwise(0.0) - F.when(F.length("value") < 4, 2.0).otherwise(0.0)
        - F.when(F.size(F.split("value", " ")) > 8, 0.8).otherwise(0.0) + F.when((F.col("source") == "OBYAVA.ua") & (F.col("kind") == "description_regex"), 0.4).otherwise(0.0)
    )
    return c.join(met, ["ord", "turn"], "left").select("ord", "turn", "value", "kind", score.alias("score"))


def best_addresses(rows: DataFrame, model: dict[str, DataFrame], least: float = 2.2) -> DataFrame:
    """(ord, value, kind, score) of each row's best candidate that scores enough; the first on ties."""
    scored = score_addresses(address_candidates(rows, model), rows, model)
    best = scored.groupBy("ord").agg(F.min_by(F.struct("value", "kind", "score"), F.struct((-F.col("score")).alias("s"), "turn")).alias("b"))
    return best.select("ord", "b.*").where(F.col("score") >= least)


def linear_scores(features: Column, mean: list[float], scale: list[float], coef: list[list[float]], intercept: list[float]) -> Column:
    """Class probabilities of a linear model over standardized features, as an array; a scale of zero counts as one.

    One row of coefficients gives two classes by the logistic function, more give a softmax.
    """
    arrays = lambda v: F.array(*map(F.lit, map(float, v)))
    z = F.zip_with(F.zip_with(features, arrays(mean), lambda x, m: x - m), arrays([s or 1.0 for s in scale]), lambda x, s: x / s)
    dot = [F.aggregate(F.zip_with(z, arrays(w), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x) + F.lit(float(b)) for w, b in zip(coef, intercept)]
    if len(dot) == 1:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-dot[0]))
        return F.array(F.lit(1.0) - p, p)
    top = F.greatest(*dot)
    powers = F.array(*[F.exp(d - top) for d in dot])
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def average_probabilities(photos: DataFrame, classes: list[str], least: float = 0.62) -> DataFrame:
    """(row_id, label, probability) from probabilities (row_id, p: array) of a row's photos: mean by class, the likeliest if it is enough."""
    means = [F.avg(F.col("p")[k]).alias(f"m{k}") for k in range(len(classes))]
    ranked = F.array_max(F.array(*[F.struct(F.col(f"m{k}").alias("probability"), F.lit(-k).alias("turn"), F.lit(c).alias("label")) for k, c in enumerate(classes)]))
    return photos.groupBy("row_id").agg(*means).select("row_id", ranked.alias("r")).select("row_id", "r.label", "r.probability").where(F.col("probability") >= least)


#: Classes of a linear model, at most.
MOST_CLASSES = 1_000


def fit_linear(samples: DataFrame, label: str = "label", features: str = "features", least: int = 8) -> dict:
    """A balanced logistic regression over standardized features (population deviation), as plain numbers.

    The features are scaled here and weighted by class, and the fit runs on Spark ML, so samples stay
    distributed; only the model is brought to the driver. Too few samples or classes raise ValueError.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {r[label]: r["count"] for r in samples.groupBy(label).count().orderBy(label).limit(MOST_CLASSES + 1).collect()}
    n = sum(counts.values())
    if n < least or len(counts) < 2:
        raise ValueError(f"not enough samples: {n}, classes: {sorted(counts)}")
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes: {label} is no label")
    size = samples.select(F.size(features)).first()[0]
    stats = samples.agg(*[f(F.col(features)[k]).alias(f"{s}{k}") for k in range(size) for s, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, scale = [stats[f"m{k}"] for k in range(size)], [stats[f"s{k}"] or 1.0 for k in range(size)]
    z = F.array(*[(F.col(features)[k] - mean[k]) / scale[k] for k in range(size)])
    classes = list(counts)
    index = F.create_map(*[x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(float(k)))])[F.col(label)]
    weight = F.create_map(*[x for c, k in counts.items() for x in (F.lit(c), F.lit(n / (len(counts) * k)))])[F.col(label)]
    data = samples.select(array_to_vector(z).alias("features"), index.alias("label"), weight.alias("w"))
    fitted = LogisticRegression(maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, weightCol="w").fit(data)
    coef = np.atleast_2d(fitted.coefficientMatrix.toArray()).tolist()
    return {"classes": classes, "mean": mean, "scale": scale, "coef": coef, "intercept": [float(x) for x in fitted.interceptVector]}
