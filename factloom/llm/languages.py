"""Language identification by interpolated Kneser-Ney character models.

A text is its lower-cased letters, with one boundary for each run of anything else. Each language has a model of four
symbols: what a symbol's chance is after the three before it, by discounted counts, interpolated with the model of one
symbol less, whose counts are the distinct symbols seen before a sequence. The counts are made by Spark over all documents
learnt from; the model holds, for each number of symbols, the sequences of all languages in one sorted array of hashes and
beside it the logarithm of their chance in each language, already interpolated, so that most symbols take one look-up. A
text goes to the language of the lowest cross-entropy for each symbol.

Calibration: a part of the labelled documents is kept out of the counts. Their share of right answers, by the size of the
lead in nats, made monotone, is the ``score``; and a text whose cross-entropy is above that of all but ``TAIL`` of a
language's right ones is not ``accepted``, as is one whose score is below ``SURE``.

Bounds: a worker holds at most ``CELLS`` chances for each number of symbols, whatever the corpus. The model itself has no
bound: all its chances and weights are tables in Spark. Where those of a number of symbols do not fit, workers hold the
sequences of the highest counts (by powers of two); what a text has beside them is set aside with its counts, looked up in
the tables by joins and added to the text's sums. So results do not depend on ``CELLS``.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if nothing could be learnt.
Of equal cross-entropies the first language by name wins. A null id has the empty text as its decimal form. Letters beyond
the first 65,536 code points are one symbol. Other columns come back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames

ORDER, BITS = 4, 16
#: Symbols that are not letters: the boundary, and letters that do not fit into ``BITS``.
BOUNDARY, RARE = 1, 2
#: Chances a worker holds at most for each number of symbols, over all languages; the others are joined.
CELLS = 1 << 22
#: Documents are dealt to so many folds: one is held out, one calibrates.
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 1
TAIL, SURE = 0.001, 0.5
#: Characters that are worked on together, and symbols that are looked up together (divided by the languages).
TOGETHER, LOOKUPS = 1 << 20, 1 << 21
#: Pairs of a language and a sequence that a task counts before it passes them on.
HELD = 1 << 21
#: Steps of a cross-entropy and of the logarithm of a lead, in the histograms.
STEP, LEADS = 1 / 32, 64

U = np.uint64


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The symbol of each code point; 0 for all but letters."""
    out = np.zeros(0x110000, dtype=np.uint16)
    for i in range(len(out)):
        if (c := chr(i)).isalpha():
            low = ord(c.lower()[0])
            out[i] = low if low < 1 << BITS else RARE
    return out


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str], bool, bool]]:
    """``(index of the first text, texts, whether they go on one that has begun, whether they end)``, of about ``TOGETHER`` characters."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if len(t) > TOGETHER:
            if first < i:
                yield first, texts[first:i], False, True
            for at in range(0, len(t), TOGETHER):
                yield i, [t[at : at + TOGETHER]], at > 0, at + TOGETHER >= len(t)
            first, held = i + 1, 0
            continue
        if held + len(t) > TOGETHER and first < i:
            yield first, texts[first:i], False, True
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:], False, True


def sequences(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(codes, texts)``: each symbol with the three before it, packed, and the index of its text, a part at a time.

    Before the first symbol of a text stand boundaries.
    """
    before = np.full(ORDER - 1, BOUNDARY, dtype=U)
    for first, own, goes_on, ends in _parts(texts):
        if not goes_on:
            before = np.full(ORDER - 1, BOUNDARY, dtype=U)
        points = np.frombuffer(("\0".join(own) + "\0" * ends).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol = _symbols()[points]
        letter = symbol != 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] |= before[-1] != BOUNDARY
        sizes = np.array([len(t) + 1 for t in own])
        sizes[-1] -= not ends
        text = np.repeat(np.arange(len(own)), sizes)[keep]
        s = np.where(letter, symbol, BOUNDARY)[keep].astype(U)
        if len(s) == 0:
            continue
        whole = np.concatenate([before, s])
        place = np.arange(len(s)) - np.searchsorted(text, text) + (ORDER if goes_on else 0)
        codes = s.copy()
        for back in range(1, ORDER):
            codes |= np.where(place >= back, whole[ORDER - 1 - back : len(whole) - back], U(BOUNDARY)) << U(BITS * back)
        before = whole[-(ORDER - 1) :]
        yield codes, text + first


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over ``docs(lang, text)``: how often each packed sequence of ``ORDER`` symbols occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, back = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            return grams, np.bincount(back, np.concatenate([n for _, n in held[lang]]), len(grams)).astype(np.int64)

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                grams, n = merged(lang)
                del held[lang]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for whole in batches:
            for batch in frames.slices(whole, "text", 4 * TOGETHER):
                langs = batch.column("lang").to_pylist()
                known = sorted(set(langs))
                of = np.array([known.index(x) for x in langs])
                for codes, text in sequences(_strings(batch)):
                    for i in np.unique(of[text]):
                        held.setdefault(known[i], []).append(np.unique(codes[of[text] == i], return_counts=True))
                if sum(len(g) for own in held.values() for g, _ in own) > HELD:
                    for lang in held:
                        held[lang] = [merged(lang)]
                    if sum(len(own[0][0]) for own in held.values()) > HELD // 2:
                        yield from passed_on()
        yield from passed_on()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """For each number of symbols from 1: sorted hashes of sequences with the logarithm of their chance in each language,
    and sorted hashes of what stands before the last symbol with the logarithm of the weight of the next smaller number.

    ``whole``: all sequences of that number are held. If they are not, neither is what stands before, and a sequence that
    is not held must be looked up in ``tables``: ``(gram, n, chances)`` and ``(before, left)``, which stay with the driver.
    """

    langs: list[str]
    keys: list[np.ndarray]
    chances: list[np.ndarray]
    before: list[np.ndarray]
    weights: list[np.ndarray]
    unknown: np.ndarray
    whole: list[bool]
    tables: list[tuple[DataFrame, DataFrame]]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": []}

    def look_up(self, grams: np.ndarray, size: int = ORDER) -> np.ndarray:
        """``(grams, languages)``: the logarithm of the chance of each packed sequence's last symbol after the others; ``-inf`` where only the tables know."""
        if size == 0:
            return np.broadcast_to(self.unknown, (len(grams), len(self.langs)))
        at, hit = _found(self.keys[size - 1], grams)
        out = self.chances[size - 1][at] if len(self.keys[size - 1]) else np.empty((len(grams), len(self.langs)), np.float32)
        if not hit.all():
            out[~hit] = self._unseen(grams[~hit], size) if self.whole[size - 1] else -np.inf
        return out

    def _unseen(self, grams: np.ndarray, size: int) -> np.ndarray:
        lower = self.look_up(grams & U((1 << BITS * (size - 1)) - 1), size - 1)
        at, seen = _found(self.before[size - 1], grams >> U(BITS))
        return lower + np.where(seen[:, None], self.weights[size - 1][at], np.float32(0))


def _found(keys: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each gram's hash stands in the sorted hashes, and whether it does."""
    if not len(keys):
        return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
    hashes = frames.mixed(grams)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return at, keys[at] == hashes


def _least_count(tables: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` sequences were counted so often."""
    sizes = {r.bin: r.n for r in tables.groupBy(F.floor(F.log2("n")).alias("bin")).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    bin_ = 0
    while sum(n for b, n in sizes.items() if b >= bin_) > most:
        bin_ += 1
    return 1 << bin_


def fitted(docs: DataFrame) -> Model | None:
    """The model of ``docs(lang, text)``; rows with a null in either are not learnt from. None without rows to learn from."""
    table = frames.cut(counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")))
    langs = sorted(r.lang for r in table.select("lang").distinct().collect())  # one row a language
    if not langs:
        return None
    tables = [table]
    for size in range(ORDER - 1, 0, -1):  # the distinct symbols before each shorter sequence
        tables.insert(0, frames.cut(tables[0].groupBy("lang", _shorter(size + 1).alias("gram")).agg(F.count("*").alias("n"))))
    model = Model(langs, [], [], [], [], np.zeros(len(langs), np.float32), [], [])
    for size, table in enumerate(tables, 1):
        _add(model, size, table)
    return model


def _shorter(size: int) -> Column:
    """A packed sequence of ``size`` symbols without its first."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1))


def _before() -> Column:
    """What stands before the last symbol."""
    return F.shiftrightunsigned("gram", BITS)


def _add(model: Model, size: int, table: DataFrame) -> None:
    """Add the sequences of ``size`` symbols to a model of the shorter ones: all to the tables, the most frequent to what workers hold."""
    few = {r.lang: (r.one, r.two) for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
    discounts = {x: min(0.95, max(0.1, few[x][0] / (few[x][0] + 2 * few[x][1]) if few[x][1] else 0.5)) for x in model.langs}
    less = F.col("n") - F.create_map(*(F.lit(v) for pair in discounts.items() for v in pair))[F.col("lang")]
    table = table.select("lang", "gram", "n", less.alias("less"), _before().alias("before"))
    each = lambda value: F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == x, value)), F.lit(0.0)) for x in model.langs))
    sums = frames.cut(table.groupBy("lang", "before").agg(F.sum("n").alias("total"), F.sum("less").alias("less")))
    left = sums.groupBy("before").agg(each(F.col("less") / F.col("total")).alias("taken"))
    left = frames.cut(left.select("before", F.transform("taken", lambda x: F.log(F.greatest(1 - x, F.lit(1e-12)))).alias("left")))
    shares = table.join(sums.drop("less"), ["lang", "before"]).groupBy("gram").agg(F.sum("n").alias("n"), each(F.col("less") / F.col("total")).alias("share"))
    if size == 1:
        symbols = table.select("gram").distinct().count()
        model.unknown = np.full(len(model.langs), -np.log(symbols + 1), dtype=np.float32)  # every symbol alike, and one never seen
        lower = shares.withColumn("lower", _unknown(model))
    else:  # each sequence's end is one of the shorter
        lower = shares.withColumn("shorter", _shorter(size)).join(model.tables[-1][0].select(F.col("gram").alias("shorter"), F.col("chances").alias("lower")), "shorter")
    rest = F.zip_with("lower", "left", lambda x, y: F.exp(x + y))
    chances = F.zip_with("share", rest, lambda x, y: F.log(x + y).cast("float"))
    full = frames.cut(lower.withColumn("before", _before()).join(left, "before").select("gram", "n", chances.alias("chances")))
    model.tables.append((full, left))
    least = _least_count(full, CELLS // len(model.langs))
    model.whole.append(least == 1)
    _hold(model.keys, model.chances, full.where(F.col("n") >= least).select("gram", "chances"))  # at most CELLS / languages
    _hold(model.before, model.weights, left if least == 1 else left.limit(0))  # no more than the sequences


def _unknown(model: Model) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in model.unknown))


def _hold(keys: list[np.ndarray], values: list[np.ndarray], rows: DataFrame) -> None:
    """Bring packed sequences and their arrays of numbers to the driver, in order of the sequences' hashes."""
    got = rows.toArrow().combine_chunks()
    hashes = frames.mixed(got.column(0).to_numpy().view(U))
    order = np.argsort(hashes)
    lists = got.column(1).combine_chunks()
    keys.append(hashes[order])
    values.append(lists.flatten().to_numpy().astype(np.float32).reshape(len(order), -1 if len(order) else 1)[order])


def _from_tables(grams: DataFrame, model: Model, size: int = ORDER) -> DataFrame:
    """``gram, chances`` of distinct packed sequences of ``size`` symbols, as :meth:`Model.look_up` has them where all are held."""
    table, left = model.tables[size - 1]
    at = frames.cut(grams.join(table.select("gram", "chances"), "gram", "left"))
    rest = at.where("chances IS NULL").select("gram", _before().alias("before"), _shorter(size).alias("shorter"))
    if size == 1:
        rest = rest.withColumn("lower", _unknown(model))
    else:
        lower = _from_tables(rest.select(F.col("shorter").alias("gram")).distinct(), model, size - 1)
        rest = rest.join(lower.withColumnsRenamed({"gram": "shorter", "chances": "lower"}), "shorter")
    weighed = F.zip_with("lower", "left", lambda x, y: x + y.cast("float"))
    rest = rest.join(left, "before", "left").select("gram", F.when(F.col("left").isNull(), F.col("lower")).otherwise(weighed).alias("chances"))
    return at.where("chances IS NOT NULL").union(rest)


def _with_gaps(scored: DataFrame, model: Model) -> DataFrame:
    """``scored`` with the sums of the sequences set aside, ``grams`` and how often, ``times``, added to ``logs``."""
    scored = frames.cut(scored.withColumn("id", F.monotonically_increasing_id()))
    gaps = scored.select("id", F.explode(F.arrays_zip("grams", "times")).alias("gap")).select("id", F.col("gap.grams").alias("gram"), F.col("gap.times").alias("n"))
    found = frames.cut(_from_tables(gaps.select("gram").distinct(), model))
    more = gaps.join(found, "gram").groupBy("id").agg(F.array(*(F.sum(F.col("n") * F.col("chances")[i].cast("double")) for i in range(len(model.langs)))).alias("more"))
    logs = F.when(F.col("more").isNull(), F.col("logs")).otherwise(F.zip_with("logs", "more", lambda x, y: x + y))
    return scored.join(more, "id", "left").withColumn("logs", logs).drop("id", "grams", "times", "more")


def _scored(docs: DataFrame, keep: list[str] | None, model: Model, **others: Column) -> DataFrame:
    """``row``, ``others`` and the cross-entropy of each language (null without a letter), of whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = frames.packed(docs, keep, **others, text=F.col("text"))
    whole_model = all(model.whole)

    def lists(ends: np.ndarray, values: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=None if none is None else pa.array(none))

    def set_aside(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[pa.Array]:
        """``grams`` and ``times`` of each text from pairs of texts and sequences."""
        text, grams = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, U))
        order = np.lexsort((grams, text))
        text, grams = text[order], grams[order]
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (grams[1:] != grams[:-1]))[: len(text)])
        ends = np.searchsorted(text[first], np.arange(n + 1))
        return [lists(ends, grams[first].view(np.int64)), lists(ends, np.diff(np.append(first, len(text))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        step = max(1024, LOOKUPS // len(model.langs))
        for whole in batches:
            for batch in frames.slices(whole, "text", 4 * TOGETHER):
                n = batch.num_rows
                sums, symbols, letters = np.zeros((n, len(model.langs))), np.zeros(n, np.int64), np.zeros(n, np.int64)
                aside: list[tuple[np.ndarray, np.ndarray]] = []
                for codes, text in sequences(_strings(batch)):
                    symbols += np.bincount(text, minlength=n)
                    letters += np.bincount(text[(codes & U((1 << BITS) - 1)) != BOUNDARY], minlength=n)
                    for at in range(0, len(codes), step):
                        chance = model.look_up(codes[at : at + step])
                        if not whole_model and (gap := np.isneginf(chance[:, 0])).any():
                            aside.append((text[at : at + step][gap], codes[at : at + step][gap]))
                            chance[gap] = 0
                        for i in range(len(model.langs)):
                            sums[:, i] += np.bincount(text[at : at + step], chance[:, i], n)
                logs = lists(np.arange(n + 1) * len(model.langs), sums.ravel(), letters == 0)
                kept = [i for i, c in enumerate(batch.schema.names) if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), logs, pa.array(symbols), *([] if whole_model else set_aside(aside, n))], names=[*(batch.schema.names[i] for i in kept), *added])

    fields = [rows.schema["row"], *(rows.schema[c] for c in others)]
    added = ["logs", "n_symbols", *([] if whole_model else ["grams", "times"])]
    ddl = "logs array<double>, n_symbols bigint" + ("" if whole_model else ", grams array<bigint>, times array<bigint>")
    scored = rows.mapInArrow(run, frames.schema_of(fields, ddl))
    if not whole_model:
        scored = _with_gaps(scored, model)
    symbols = F.greatest("n_symbols", F.lit(1))
    return scored.select("row", *others, F.transform("logs", lambda x: (-x / symbols).cast("float")).alias("entropies"), "n_symbols")


def _verdict(scored: DataFrame, langs: list[str]) -> DataFrame:
    """With ``best`` (index of the language), ``entropy`` and ``lead``: 0 to ``LEADS``, by the logarithm of the nats between the best two."""
    low = F.array_min("entropies")
    best = F.array_position("entropies", low).cast("int")
    second = F.array_min(F.filter("entropies", lambda x, i: i + 1 != best)) if len(langs) > 1 else F.lit(None)
    nats = F.coalesce((second - low) * F.col("n_symbols"), F.lit(float(1 << 30)))
    return scored.withColumns({"best": best, "entropy": low.cast("double"), "lead": F.least(F.greatest(F.floor(2 * F.log2(nats + 1)), F.lit(0)), F.lit(LEADS)).cast("int")})


@dataclass(frozen=True)
class Calibration:
    scores: list[float]
    """Of each lead."""
    limits: list[float]
    """The highest cross-entropy accepted, of each language."""


def calibrated(labelled: DataFrame, model: Model) -> Calibration:
    """From ``labelled(lang, text)`` rows that ``model`` has not learnt from."""
    of = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")).cast("int")
    rows = _verdict(_scored(labelled.where("lang IS NOT NULL"), [], model, actual=of), model.langs).where("entropies IS NOT NULL")
    rows = frames.cut(rows.groupBy("lead", "best", F.floor(F.col("entropy") / STEP).cast("int").alias("bin"), (F.col("best") == F.col("actual")).alias("right")).agg(F.count("*").alias("n")))
    leads = {r.lead: (r.right, r.n) for r in rows.groupBy("lead").agg(F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("n")).collect()}  # at most LEADS + 1 rows
    limits = []
    bins = rows.where("right").groupBy("best", "bin").agg(F.sum("n").alias("n")).collect()  # languages x some hundred steps
    for i in range(1, len(model.langs) + 1):
        own = sorted((r.bin, r.n) for r in bins if r.best == i)
        total, seen, limit = sum(n for _, n in own), 0, float("inf")
        for bin_, n in own:
            seen += n
            limit = (bin_ + 1) * STEP
            if seen >= (1 - TAIL) * total:
                break
        limits.append(limit)
    return Calibration(_monotone([leads.get(k, (0, 0)) for k in range(LEADS + 1)], 1 / len(model.langs)), limits)


def _monotone(shares: list[tuple[int, int]], chance: float) -> list[float]:
    """Shares of right answers that never fall, by joining neighbours until none does; ``chance`` counts as one answer in each."""
    blocks: list[list[float]] = []  # right, all, how many
    for right, n in shares:
        blocks.append([right, n, 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    out = [((right + chance) / (n + 1), int(k)) for right, n, k in blocks]
    best, flat = 0.0, []
    for share, k in out:
        best = max(best, share)
        flat += [best] * k
    return flat


def identified(docs: DataFrame, model: Model | None, calibration: Calibration | None, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, by default all) with ``lang_pred, score, cross_entropy, accepted``."""
    if model is None or calibration is None:
        nothing = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "accepted": F.lit(False)}
        return frames.packed(docs, keep, **nothing)
    rows = _verdict(_scored(docs, keep, model), model.langs)
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("best") - 1)
    known = F.col("entropies").isNotNull()
    score = F.when(known, F.get(F.array(*map(F.lit, calibration.scores)), F.col("lead"))).otherwise(0.0)
    return rows.select("row", F.when(known, of(model.langs)).otherwise("und").alias("lang_pred"), score.alias("score"), "entropy", F.coalesce((score >= SURE) & (F.col("entropy") <= of(calibration.limits)), F.lit(False)).alias("accepted")).withColumnRenamed("entropy", "cross_entropy")


def learnt(docs: DataFrame, part: Callable[[Column], Column] = fold) -> tuple[Model | None, Calibration | None]:
    """A model and its calibration from ``docs(doc_id, text, lang)``, without the fold ``HELD_OUT``."""
    of = part(F.col("doc_id"))
    model = fitted(docs.where((of != HELD_OUT) & (of != CALIBRATES)))
    return model, model and calibrated(docs.where(of == CALIBRATES), model)


def predicted(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, accepted`` of each row of ``docs``, learnt from those not held out."""
    rows = identified(docs, *learnt(docs), keep=["doc_id"])
    return rows.select("row.doc_id", (fold(F.col("row.doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
