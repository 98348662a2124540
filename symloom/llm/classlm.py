"""Scoring texts with a Brown class bigram model learnt from the corpus.

Training documents are counted word by word (a word is a 64-bit hash from here on). Every word has a
class of its own, found in two steps. The ``TOP`` most frequent words and ``GROUPS`` groups of the other
words, by ending, are first moved one by one between classes, which gives a start. Then every word of
the vocabulary is moved by exchange, in ``ROUNDS`` distributed rounds: a round counts, for each word
whose turn it is (by hash), the classes before and after it over the whole training corpus, and moves the
word to the class where the likelihood is largest beside the class table of the round's start. A round
that lowers the likelihood is undone. There are ``CLASSES`` classes, or the fourth root of the vocabulary
if that is more. The model is P(class | class before) * P(word | class), both smoothed; a word that
training never saw has the class its group started in. The unigram base is scored beside it.

Texts are encoded once. Counts, classes and bigrams stay distributed; the driver and all tasks get the
class table and at most ``HEAD`` frequent words with count and class, which merely save a shuffle for
common words: every other token is joined with the word table by its hash.

Defined results: a null or empty text is its end token; a null id is the empty string for the hold-out
(held out) and stays null; repeated rows are scored, and counted, one by one; an empty table gives an
empty result, an untrained model scores by smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, texts

TOP, GROUPS, CLASSES = 400, 112, 48
HEAD = 2**20
ADD = 0.1
END = 1
SWEEPS = 6
ROUNDS = 2
_FLUSH = 400_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def group_of(word: bytes) -> int:
    """Group of a word by its ending; never by its count, so every word has one."""
    return zlib.crc32(word[-3:]) % GROUPS


def held_out(doc_id):
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0, F.lit(True))


def _batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def word_counts(train: DataFrame) -> DataFrame:
    """h, g (group), n of every word of ``train`` (text), and of the end token."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("n", pa.int64())])

    def run(batches):
        seen: Counter = Counter()
        ends = 0
        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(text.lower().split())
                ends += 1
                if len(seen) > _FLUSH:
                    yield _batch(schema, ([word_hash(w) for w in seen], [group_of(w) for w in seen], list(seen.values())))
                    seen.clear()
        if ends:
            yield _batch(schema, ([*map(word_hash, seen), END], [*map(group_of, seen), -1], [*seen.values(), ends]))

    return train.mapInArrow(run, "h long, g int, n long").groupBy("h").agg(F.first("g").alias("g"), F.sum("n").alias("n"))


class Codes(dict):
    """word -> rank of a head word, or -1 - its place in growing arrays of other words' hash and group."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.keys, self.ranks = keys, ranks
        self.reset()

    def reset(self):
        self.clear()
        self.hashes, self.groups = array("q"), array("h")

    def learn(self, words) -> None:
        """Codes for the words that have none yet, all at once."""
        if len(self) > _FLUSH:
            self.reset()
        new = list(set(words).difference(self))
        if not new:
            return
        hashes = np.fromiter(map(word_hash, new), dtype=np.int64, count=len(new))
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(new), dtype=bool)
        inside = np.flatnonzero(at < len(self.keys))
        known[inside] = self.keys[at[inside]] == hashes[inside]
        codes = np.empty(len(new), dtype=np.int64)
        codes[known] = self.ranks[at[known]]
        codes[~known] = -1 - len(self.hashes) - np.arange(int((~known).sum()))
        self.hashes.extend(hashes[~known].tolist())
        self.groups.extend([group_of(new[i]) for i in np.flatnonzero(~known).tolist()])
        self.update(zip(new, codes.tolist(), strict=True))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


ITEMS = TOP + GROUPS + 1  # the last is the end token, which also opens a text
_ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("ids", pa.list_(pa.int32())), ("tails", pa.list_(pa.int64())), ("groups", pa.list_(pa.int16()))])
_SLICE = 4096
_BLOCK_BYTES = 1 << 22


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0), type=kind, safe=False))


def _text_blocks(batch: pa.RecordBatch):
    """(rows, their texts) of a batch, in runs of up to 512 rows or about ``_BLOCK_BYTES``."""
    found, at = texts(batch.column(3)), 0
    while at < len(found):
        end, size = at, 0
        while end < len(found) and end - at < 512 and size < _BLOCK_BYTES:
            size += len(found[end])
            end += 1
        yield batch.slice(at, end - at), found[at:end]
        at = end


def _encoder(sent):
    """Texts as ranks of head words, -1 for another word, whose hash and group follow in order."""

    def run(batches):
        codes = Codes(*sent.value)
        for batch in batches:
            for part, block in _text_blocks(batch):
                split = [t.lower().split() for t in block]
                codes.learn(chain.from_iterable(split))
                ids, tails, groups = [], [], []
                for words in split:
                    seq = codes.of(words)
                    low = -1 - seq[seq < 0]
                    tails.append(np.frombuffer(codes.hashes, dtype=np.int64)[low] if len(low) else low)
                    groups.append(np.frombuffer(codes.groups, dtype=np.int16)[low] if len(low) else low)
                    ids.append(np.maximum(seq, -1))
                columns = [*(part.column(i) for i in range(3)), _lists(ids, pa.int32()), _lists(tails, pa.int64()), _lists(groups, pa.int16())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ENCODED, strict=True)], schema=_ENCODED)

    return run


def _streams(batches, end: int):
    """Slices of encoded rows as (slice, stream, tails, groups, lengths): each text follows an end token, and one closes the last."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            lists = part.column(3)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            stream = np.full(len(flat) + len(lengths) + 1, end, dtype=np.int64)
            stream[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)) + 1, lengths)] = flat
            yield part, stream, part.column(4).flatten().to_numpy(zero_copy_only=False), part.column(5).flatten().to_numpy(zero_copy_only=False), lengths


def pair_counts(encoded: DataFrame, of_head: np.ndarray, of_group: np.ndarray | None, size: int) -> np.ndarray:
    """Counts of neighbouring values (a small number of them); without ``of_group``, of pairs of head words only."""
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(size * size, dtype=np.int64)
        for _, stream, _, groups, _ in _streams(batches, len(of_head) - 1):
            values = of_head[stream].astype(np.int64)
            values[stream < 0] = -1 if of_group is None else of_group[groups]
            pairs = (values[:-1] * size + values[1:])[(values[:-1] >= 0) & (values[1:] >= 0)]
            total += np.bincount(pairs, minlength=size * size)
        at = np.flatnonzero(total)
        yield _batch(schema, (at, total[at]))

    return _square(encoded.mapInArrow(run, "k long, n long"), size)


def _square(pairs: DataFrame, size: int) -> np.ndarray:
    got = pairs.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item by exchange: each item in turn moves to the class where the likelihood is largest."""
    size = len(bigrams)
    weight = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = np.lexsort((np.arange(size), -weight))
    order = order[order != size - 1]
    of = np.zeros(size, dtype=np.int64)
    of[order] = np.arange(size - 1) % (classes - 1)
    of[size - 1] = classes - 1  # the end token stands alone
    member = np.eye(classes)[of]
    table = member.T @ bigrams @ member
    for _ in range(sweeps):
        moved = 0
        for i in order:
            mine, self_ = of[i], bigrams[i, i]
            out, into = bigrams[i] @ member, bigrams[:, i] @ member
            out[mine] -= self_
            into[mine] -= self_
            table[mine, :] -= out
            table[:, mine] -= into
            table[mine, mine] -= self_
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            base = _xlogx(table)
            gain_out, gain_in = _xlogx(table + out[None, :]) - base, _xlogx(table + into[:, None]) - base
            diag = np.diagonal(table)
            gain = gain_out.sum(axis=1) - np.diagonal(gain_out) + gain_in.sum(axis=0) - np.diagonal(gain_in)
            gain += _xlogx(diag + out + into + self_) - _xlogx(diag)
            gain -= _xlogx(rows + out.sum() + self_) - _xlogx(rows) + _xlogx(cols + into.sum() + self_) - _xlogx(cols)
            gain[classes - 1] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[mine] + 1e-9:
                best = int(mine)
            moved += best != mine
            member[i, mine], member[i, best], of[i] = 0, 1, best
            table[best, :] += out
            table[:, best] += into
            table[best, best] += self_
        if not moved:
            break
    return of


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def contexts(encoded: DataFrame, sent) -> DataFrame:
    """A row for each token that is no head word: its neighbours' hashes, and classes where these are head words (else -1)."""
    schema = pa.schema([("row", pa.int64()), ("held", pa.bool_()), ("pos", pa.int32()), ("h", pa.int64()), ("g", pa.int16()), ("lh", pa.int64()), ("rh", pa.int64()), ("lc", pa.int16()), ("rc", pa.int16())])

    def run(batches):
        hashes, classes = sent.value
        for part, stream, tails, groups, lengths in _streams(batches, len(hashes) - 1):
            low = np.flatnonzero(stream < 0)
            keys, of = hashes[stream], classes[stream]
            keys[low], of[low] = tails, -1
            doc = np.searchsorted(np.cumsum(lengths + 1), low - 1, side="right")
            yield _batch(schema, (part.column(0).to_numpy()[doc], part.column(2).to_numpy(zero_copy_only=False)[doc].astype(bool), low, tails, groups, keys[low - 1], keys[low + 1], of[low - 1], of[low + 1]))

    return encoded.mapInArrow(run, "row long, held boolean, pos int, h long, g short, lh long, rh long, lc short, rc short")


def neighbour_counts(encoded: DataFrame, sent, classes: int, turn: int) -> DataFrame:
    """h, codes, ns: how often each word whose turn it is precedes (code c) or follows (classes + c) class c, for head neighbours; in parts."""
    schema = pa.schema([("h", pa.int64()), ("codes", pa.list_(pa.int16())), ("ns", pa.list_(pa.int32()))])

    def run(batches):
        hashes, of_head = sent.value
        for _, stream, tails, _, _ in _streams(batches, len(hashes) - 1):
            if len(stream) < 2:
                continue
            own, at = np.unique(tails, return_inverse=True)
            names = np.concatenate([hashes, own])
            word, of = stream.copy(), of_head[stream].astype(np.int64)
            low = stream < 0
            word[low], of[low] = len(hashes) + at, -1
            mine = (names % ROUNDS == turn) & (np.arange(len(names)) != len(hashes) - 1)
            out, into = mine[word[:-1]] & (of[1:] >= 0), mine[word[1:]] & (of[:-1] >= 0)
            keys = np.concatenate([word[:-1][out] * (2 * classes) + of[1:][out], word[1:][into] * (2 * classes) + classes + of[:-1][into]])
            keys, ns = np.unique(keys, return_counts=True)
            first = np.flatnonzero(np.diff(keys // (2 * classes), prepend=-1))
            offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
            columns = [pa.array(names[keys[first] // (2 * classes)]), pa.ListArray.from_arrays(offsets, pa.array(keys % (2 * classes), type=pa.int16())), pa.ListArray.from_arrays(offsets, pa.array(ns, type=pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return encoded.mapInArrow(run, "h long, codes array<short>, ns array<int>")


def best_classes(own: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class each word (numbered from 0, at home in ``own``) would rather be in, from its counts by code beside ``table``."""
    classes = len(table)
    keys, at = np.unique(word * (2 * classes) + code, return_inverse=True)
    n = np.bincount(at, weights=n)
    word, code = keys // (2 * classes), keys % (2 * classes)
    cells = np.concatenate([table.T, table])
    plain, edges = _xlogx(cells), (table.sum(axis=1), table.sum(axis=0))
    best = own.copy()
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    for lo in range(0, len(firsts), 4096):
        first = firsts[lo : lo + 4096]
        till = firsts[lo + 4096] if lo + 4096 < len(firsts) else len(word)
        part = slice(first[0], till)
        c, m, w = code[part], n[part], word[first]
        gain = _xlogx(cells[c] + m[:, None]) - plain[c]
        home, rows = own[word[part]], np.arange(len(c))
        gain[rows, home] = plain[c, home] - _xlogx(np.maximum(cells[c, home] - m, 0))
        gain = np.add.reduceat(gain, first - first[0], axis=0)
        home, rows = own[w], np.arange(len(w))
        for edge, side in zip(edges, (c < classes, c >= classes), strict=True):
            mass = np.add.reduceat(np.where(side, m, 0.0), first - first[0])
            loss = _xlogx(edge + mass[:, None]) - _xlogx(edge)
            loss[rows, home] = _xlogx(edge[home]) - _xlogx(np.maximum(edge[home] - mass, 0))
            gain -= loss
        gain[:, classes - 1] = -np.inf
        to = gain.argmax(axis=1)
        best[w] = np.where(gain[rows, to] > gain[rows, home] + 1e-9, to, home)
    return best


def _mover(sent):
    """Rows (h, n, c, codes, ns), sorted by h, one of each word with n and c -> h, n, c after the move."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("c", pa.int16())])

    def settle(t: pa.Table, table):
        hs = t.column("h").to_numpy()
        first = np.diff(hs, prepend=hs[0] - 1) != 0
        word = np.cumsum(first) - 1
        known = t.column("c").is_valid().to_numpy()
        own = np.zeros(word[-1] + 1, dtype=np.int64)
        count = np.zeros(word[-1] + 1, dtype=np.int64)
        own[word[known]] = t.column("c").drop_null().to_numpy()
        count[word[known]] = t.column("n").drop_null().to_numpy()
        codes, ns = t.column("codes").combine_chunks(), t.column("ns").combine_chunks()
        lengths = np.diff(codes.offsets.to_numpy())
        c = best_classes(own, np.repeat(word, lengths), codes.flatten().to_numpy().astype(np.int64), ns.flatten().to_numpy(), table)
        return _batch(schema, (hs[first], count, c))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            hs = rows.column("h").to_numpy()
            cut = int(np.searchsorted(hs, hs[-1]))
            if cut:
                yield settle(rows.slice(0, cut).combine_chunks(), sent.value)
            held = rows.slice(cut)
        if held is not None:
            yield settle(held.combine_chunks(), sent.value)

    return run


class Model:
    """What every task needs: classes of items, log10 transitions and emission denominators; and of head words, classes and hashes."""

    def __init__(self, top, hashes, logs, of, classes, transitions, denominators):
        self.top, self.hashes, self.logs, self.of, self.classes, self.transitions, self.denominators = top, hashes, logs, of, classes, transitions, denominators


def encode(spark: SparkSession, stages: Stages, rows: DataFrame, hashes: np.ndarray) -> DataFrame:
    """row, doc_id, held, ids, tails, groups of ``rows`` (row, doc_id, held, text); ``hashes`` are of the head words by rank."""
    keys = np.argsort(hashes[:-1])
    sent = spark.sparkContext.broadcast((hashes[:-1][keys], keys))
    return stages.keep(rows.mapInArrow(_encoder(sent), "row long, doc_id long, held boolean, ids array<int>, tails array<long>, groups array<short>"), "encoded")


def _tails(encoded: DataFrame, words: DataFrame, sent, of_group) -> DataFrame:
    """The contexts of tokens that are no head word, with their own class and count; an unseen word has its group's class."""
    met = contexts(encoded, sent).join(words.select("h", "n", "c"), "h", "left")
    unseen = F.element_at(F.array(*[F.lit(int(c)) for c in of_group]), F.col("g") + 1)
    return met.withColumn("c", F.coalesce(F.col("c").cast("int"), unseen)).withColumn("n", F.coalesce("n", F.lit(0)))


def _with_left(tails: DataFrame) -> DataFrame:
    """The class before each token: of a head word, or of the token before, which then stands at the row before."""
    before = F.lag("c").over(Window.partitionBy("row").orderBy("pos"))
    return tails.withColumn("lc", F.when(F.col("lc") >= 0, F.col("lc").cast("int")).otherwise(before))


def class_table(encoded: DataFrame, tails: DataFrame, of_head: np.ndarray, classes: int) -> np.ndarray:
    """Class bigrams of the training texts, over all words."""
    pairs = tails.filter("NOT held").select(F.explode(F.array(F.col("lc") * classes + F.col("c"), F.when(F.col("rc") >= 0, F.col("c") * classes + F.col("rc")))).alias("k")).filter("k IS NOT NULL")
    return pair_counts(encoded.filter("NOT held"), of_head, None, classes) + _square(pairs.select(F.col("k").cast("long").alias("k"), F.lit(1).alias("n")), classes)


def train_model(stages: Stages, train: DataFrame):
    """(model, staged counts h/g/n, N, V, count of the end token) of ``train`` (text)."""
    rows = train.select(F.monotonically_increasing_id().alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held"), "text")
    return train_encoded(stages, rows)[:5]


def train_encoded(stages: Stages, rows: DataFrame):
    """As train_model, of the rows (row, doc_id, held, text) that are not held, plus all rows encoded and their staged ``_tails``."""
    spark = stages.spark
    counts = stages.keep(word_counts(rows.filter("NOT held").select("text")), "counts")
    level = F.floor(F.log2("n") * 16).cast("int")
    total = counts.agg(F.sum("n").alias("N"), F.count("*").alias("V")).first()
    least, room = None, HEAD
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 16 * 63 rows
        if row["count"] > room:
            break
        room, least = room - row["count"], row["level"]
    is_head = level >= least if least is not None else F.lit(False)
    head = counts.filter(is_head).toArrow()
    hs, gs, ns = (head.column(i).to_numpy() for i in range(3))
    ends = counts.filter(F.col("h") == END).agg(F.sum("n")).first()[0] or 0
    order = np.lexsort((hs, -ns))
    order = order[hs[order] != END]
    hashes, counted = np.append(hs[order], END), np.append(ns[order], ends)
    top = {int(h): n for n, h in enumerate(hashes[:-1][:TOP])}
    encoded = encode(spark, stages, rows, hashes)
    items = np.append(TOP + gs[order], ITEMS - 1).astype(np.int64)
    items[: len(top)] = np.arange(len(top))
    classes = max(CLASSES, round((total["V"] or 0) ** 0.25))
    bigrams = pair_counts(encoded.filter("NOT held"), items, np.arange(TOP, TOP + GROUPS), ITEMS)
    of = exchange(bigrams, classes)
    member = np.eye(classes)[of]
    table = member.T @ bigrams @ member
    of_head = of[items].astype(np.int16)
    of_group = of[TOP : TOP + GROUPS]
    first = spark.createDataFrame([(g, int(c)) for g, c in enumerate(of_group)], "g int, c short")
    seeded = spark.createDataFrame(pa.table({"h": hashes[: len(top)], "s": of_head[: len(top)]})) if top else spark.createDataFrame([], "h long, s short")
    words = counts.filter(F.col("h") != END).join(F.broadcast(first), "g").join(F.broadcast(seeded), "h", "left")
    words = stages.keep(words.select("h", "n", F.coalesce("s", "c").cast("short").alias("c")), "words")
    sent = spark.sparkContext.broadcast((hashes, of_head))
    tails = stages.keep(_with_left(_tails(encoded, words, sent, of_group)), "tails")
    for turn in range(ROUNDS):
        seen = tails.filter("NOT held")
        beside = seen.select(F.explode(F.array(F.struct(F.col("lh").alias("h"), F.col("c").alias("code")), F.struct(F.col("rh").alias("h"), (F.col("c") + classes).alias("code")))).alias("x")).select("x.*").filter((F.col("h") != END) & (F.pmod("h", F.lit(ROUNDS)) == turn))
        beside = beside.groupBy("h", "code").count().select("h", F.array(F.col("code").cast("short")).alias("codes"), F.array(F.col("count").cast("int")).alias("ns"))
        parts = neighbour_counts(encoded.filter("NOT held"), sent, classes, turn).unionByName(beside).select("h", F.lit(None).cast("long").alias("n"), F.lit(None).cast("short").alias("c"), "codes", "ns")
        own = words.select("h", "n", "c", F.array().cast("array<short>").alias("codes"), F.array().cast("array<int>").alias("ns"))
        moved = parts.unionByName(own).repartition("h").sortWithinPartitions("h").mapInArrow(_mover(spark.sparkContext.broadcast(table)), "h long, n long, c short")
        moved = stages.keep(moved, "words")
        got = moved.filter(is_head).toArrow()
        at, c = got.column(0).to_numpy(), got.column(2).to_numpy()
        sort = np.argsort(at)
        new = np.append(c[sort][np.searchsorted(at[sort], hashes[:-1])], classes - 1).astype(np.int16)
        resent = spark.sparkContext.broadcast((hashes, new))
        retails = stages.keep(_with_left(_tails(encoded, moved, resent, of_group)), "tails")
        again = class_table(encoded, retails, new, classes)
        if likelihood(again) < likelihood(table):
            stages.drop(moved, retails)
            continue
        stages.drop(words, tails)
        words, tails, sent, of_head, table = moved, retails, resent, new, again
    of[: len(top)] = of_head[: len(top)]
    distinct, mass = np.zeros(classes), np.zeros(classes)
    for r in words.groupBy("c").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect():
        distinct[r["c"]], mass[r["c"]] = r["v"], r["n"]
    distinct[-1], mass[-1] = 1, ends
    transitions = np.log10((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * classes))
    denominators = np.log10(mass + ADD * (distinct + 1))
    model = Model(top, hashes, np.log10(counted + ADD), of, of_head, transitions, denominators)
    return model, counts, total["N"] or 0, total["V"] or 0, ends, encoded, tails


def _scorer(sent):
    """Scores without what hangs on a token that is no head word."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("path", pa.float64())])

    def run(batches):
        model: Model = sent.value
        for part, stream, _, _, lengths in _streams(batches, len(model.hashes) - 1):
            doc = np.repeat(np.arange(len(lengths)), lengths + 1)
            of = model.classes[stream].astype(np.int64)
            of[stream < 0] = -1
            before, of, own = of[:-1], of[1:], stream[1:]
            path = np.where(of >= 0, np.where(before >= 0, model.transitions[before, of], 0.0) - model.denominators[of], 0.0)
            inside = (own >= 0) & (own < len(model.hashes) - 1)
            sums = [np.bincount(doc, weights=x, minlength=len(lengths)) for x in (inside, np.where(inside, model.logs[own], 0.0), path)]
            yield _batch(schema, (*(part.column(i) for i in range(3)), lengths + 1, sums[0].astype(np.int64), sums[1], sums[2]))

    return run


def _tail_scorer(sent):
    schema = pa.schema([("row", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("path", pa.float64())])

    def run(batches):
        model: Model = sent.value
        for batch in batches:
            left, of, right, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
            path = model.transitions[left, of] + np.where(right >= 0, model.transitions[of, right], 0.0) - model.denominators[of]
            yield _batch(schema, (batch.column(0), (n > 0).astype(np.int64), np.log10(n + ADD), path))

    return run


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of ``docs``."""
    stages = Stages(spark, "classlm")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    model, counts, n, v, ends, encoded, tails = train_encoded(stages, rows)
    sent = spark.sparkContext.broadcast(model)
    scored = encoded.mapInArrow(_scorer(sent), "row long, doc_id long, held boolean, n long, known long, logs double, path double")
    tail = tails.select("row", "lc", "c", "rc", "n").mapInArrow(_tail_scorer(sent), "row long, known long, logs double, path double")
    tail = tail.groupBy("row").agg(F.sum("known").alias("tail_known"), F.sum("logs").alias("tail_logs"), F.sum("path").alias("tail_path"))
    out = scored.join(tail, "row", "left")
    logs = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) + float(np.log10(ends + ADD))
    known = F.col("known") + F.coalesce("tail_known", F.lit(0)) + (1 if ends else 0)
    points = logs + F.col("path") + F.coalesce("tail_path", F.lit(0.0))
    return out.select("doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (logs - F.col("n") * float(np.log10(n + ADD * (v + 1)))).alias("base_score"), points.alias("score"), F.pow(F.lit(10.0), -points / F.col("n")).alias("perplexity"))
