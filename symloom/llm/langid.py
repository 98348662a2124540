"""Language ID by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per row:

* text: hashed character trigrams of the whole text under a multinomial per language. Trigrams overlap and
  follow one another, so their mean log-likelihood counts as that of ``TEMPER * min(n, REACH)`` independent
  ones: evidence saturates with length. A flat model stands for text in no known language (``und``);
* the declared markup language, with the reliability P(declared | language) counted over all rows;
* the address suffix (a two-letter first path segment, else the last label of the host), likewise;
* the host prior: counts of text posteriors per host, smoothed towards those of the registered domain,
  which are smoothed towards those of all rows.

All counts are grouped sums over every row. Only the text model is fitted on a sample: for every label
that any row has, the ``TRAIN_ROWS`` rows with the smallest hash of their id, whose trigrams are counted whole.
Texts are read once; from there on a row is a vector of log-likelihoods and three short strings.

Defined results: a text without a letter (null, empty, digits only) is ``und`` and not kept; missing
evidence of any other kind counts as none; ties go to the first language by code; labels that are
not two or three letters (after cutting at the first ``-`` or ``_``) are no labels; repeated
rows get a row each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, texts

TRAIN_ROWS = 1000
BUCKETS = 2**13
TEMPER, REACH = 0.2, 600
UND = "und"
UND_PRIOR = 0.02
KAPPA = 20.0
LEAST = 0.5
REGISTRY = r"\.(?:ac|co|com|edu|gov|net|or|org)\.[a-z]{2}$"
EVIDENCE = "doc_id long, page_id long, declared string, suffix string, host string, domain string, n long, ll array<double>"
_TAG = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LANG = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)")


def primary(code: Column) -> Column:
    short = F.lower(F.substring_index(F.substring_index(code, "-", 1), "_", 1))
    return F.when(short.rlike("^[a-z]{2,3}$"), short)


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every character trigram that holds a letter; other characters count as blanks."""
    cps = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), dtype=np.uint32)
    letter = ((cps >= 97) & (cps <= 122)) | (cps >= 0xC0)
    c = np.where(letter, cps, 32).astype(np.uint32)
    if len(c) < 3:
        c = np.concatenate([c, np.full(3 - len(c), 32, dtype=np.uint32)])
        letter = c != 32
    some = letter[:-2] | letter[1:-1] | letter[2:]
    key = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return (key[some] >> np.uint32(19)).astype(np.int64)


def plain(html: bytes) -> bytes:
    return _TAG.sub(b" ", html)


class TextModel:
    def __init__(self, codes: list[str], logs: np.ndarray):
        self.codes, self.logs = codes, logs

    def likelihoods(self, text: bytes) -> tuple[int, list[float]]:
        """(trigrams, tempered log-likelihood per language)."""
        found = trigrams(text)
        if not len(found):
            return 0, [0.0] * len(self.codes)
        at, times = np.unique(found, return_counts=True)
        mean = self.logs[:, at] @ times / len(found)
        return len(found), (mean * min(len(found), REACH) * TEMPER).tolist()


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> TextModel:
    """Trigram model of labelled (doc_id, text, lang) from at most ``train_rows`` rows of each language."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), primary(F.col("lang")).alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    order = Window.partitionBy("lang").orderBy("place")
    placed = rows.withColumn("place", F.struct(F.xxhash64("doc_id"), "doc_id"))
    # a task sends ``train_rows`` places a language; a row a language comes back, so that no text is shuffled
    cuts = placed.select("lang", "place").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= train_rows).groupBy("lang").agg(F.max("place").alias("last"))
    sample = placed.join(F.broadcast(cuts), "lang").filter("place <= last").select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("k", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], schema=schema)

    got = sample.mapInArrow(run, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    codes = sorted(set(got["lang"]))
    counts = np.zeros((len(codes) + 1, BUCKETS))
    place = {c: i for i, c in enumerate(codes)}
    counts[[place[x] for x in got["lang"]], got["k"]] = got["n"]
    logs = np.log((counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * BUCKETS))
    logs[-1] = -np.log(BUCKETS)
    return TextModel([*codes, UND], logs)


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows of evidence from documents: declared label, and the source in place of a host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.lit(False).alias("markup"), F.col("text").cast("string").alias("raw"), primary(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.lit("documents").alias("domain"))


def registered(host: Column) -> Column:
    """The last two labels of a host, or three where the last but one is a registry's own under a country code."""
    return F.when(host.rlike(REGISTRY), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows of evidence from pages: the markup declares the language."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    path = F.lower(F.regexp_extract("url", r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    suffix = F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.concat(F.lit("."), F.substring_index(host, ".", -1)))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.lit(True).alias("markup"), F.col("html").cast("string").alias("raw"), F.lit(None).cast("string").alias("declared"), suffix.alias("suffix"), host.alias("host"), registered(host).alias("domain"))


def _weigh(sent):
    def run(batches):
        model: TextModel = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                declared, sizes, lls = [], [], []
                for markup, raw, said in zip(part.column(2).to_pylist(), texts(part.column(3)), part.column(4).to_pylist(), strict=True):
                    if markup:
                        found = _LANG.search(raw)
                        said = found[1].decode().lower() if found and 2 <= len(found[1]) <= 3 else None
                        raw = plain(raw)
                    n, ll = model.likelihoods(raw)
                    declared.append(said), sizes.append(n), lls.append(ll)
                columns = [part.column(0), part.column(1), pa.array(declared, pa.string()), part.column(5), part.column(6), part.column(7), pa.array(sizes, pa.int64()), pa.array(lls, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page_id", "declared", "suffix", "host", "domain", "n", "ll"])

    return run


def _softmax(points: Column) -> Column:
    raised = F.transform(points, lambda x: F.exp(x - F.array_max(points)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _plus(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def fuse(stages: Stages, weighed: DataFrame, codes: list[str]) -> DataFrame:
    """doc_id, page_id, lang, probability, text_lang, kept of rows of log-likelihoods."""
    size = len(codes)
    flat = F.array(*[F.lit(float(np.log(UND_PRIOR if c == UND else (1 - UND_PRIOR) / max(1, size - 1)))) for c in codes])
    rows = stages.keep(weighed.withColumn("p", _softmax(_plus(F.col("ll"), flat))), "weighed")
    mass = [F.sum(F.element_at("p", i + 1)).alias(f"m{i}") for i in range(size)]
    masses = F.array(*[F.col(f"m{i}") for i in range(size)])

    def counted(*by):
        return rows.filter(f"{by[0]} IS NOT NULL AND n > 0").groupBy(*by).agg(*mass).select(*by, masses.alias("m"))

    counted_all = rows.filter("n > 0").agg(*mass).select(masses.alias("m")).first()["m"]
    total = [x or 0.0 for x in counted_all]
    everything = sum(total) or 1.0
    share = F.array(*[F.lit((x + 0.5) / (everything + 0.5 * size)) for x in total])

    def smoothed(m: Column, towards: Column) -> Column:
        whole = F.aggregate(m, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(m, towards, lambda a, b: (a + KAPPA * b) / (whole + KAPPA))

    hosts = counted("host", "domain").groupBy("host").agg(F.max("domain").alias("domain"), *[F.sum(F.element_at("m", i + 1)).alias(f"m{i}") for i in range(size)]).select("host", "domain", masses.alias("m"))
    domains = counted("domain").select("domain", smoothed(F.col("m"), share).alias("towards"))
    hosts = stages.keep(hosts.join(domains, "domain", "left").select("host", smoothed(F.col("m"), F.coalesce("towards", share)).alias("prior")), "hosts")  # written, so that the join below can split a hot host

    def reliability(by):
        seen = counted(by)
        kinds = seen.count()
        top = F.array(*[F.lit(float(x + 0.5 * max(1, kinds))) for x in total])
        return seen.select(by, F.zip_with("m", top, lambda a, b: F.log((a + 0.5) / b)).alias(f"log_{by}"))

    none = F.array(*[F.lit(0.0)] * size)
    out = rows.join(hosts, "host", "left").join(reliability("declared"), "declared", "left").join(reliability("suffix"), "suffix", "left")
    prior = F.transform(F.coalesce("prior", share), lambda x: F.log(x))
    points = _plus(_plus(F.col("ll"), prior), _plus(F.coalesce("log_declared", none), F.coalesce("log_suffix", none)))
    out = out.withColumn("points", points).withColumn("post", _softmax(F.col("points")))
    names = F.array(*[F.lit(c) for c in codes])
    best = F.array_max("post")
    lang = F.when(F.col("n") > 0, F.element_at(names, F.array_position("post", best).cast("int"))).otherwise(UND)
    by_text = F.when(F.col("n") > 0, F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))).otherwise(UND)
    kept = (lang != UND) & (best >= LEAST)
    return out.select("doc_id", "page_id", lang.alias("lang"), F.when(F.col("n") > 0, F.round(best, 6)).otherwise(0.0).alias("probability"), by_text.alias("text_lang"), kept.alias("kept"))


def identify(spark: SparkSession, rows: DataFrame, model: TextModel) -> DataFrame:
    """doc_id, page_id, lang, probability, text_lang, kept of rows made by ``document_rows`` or ``page_rows``."""
    sent = spark.sparkContext.broadcast(model)
    return fuse(Stages(spark, "langid"), rows.mapInArrow(_weigh(sent), EVIDENCE), model.codes)


def keep_known(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, any others) without those whose language is not recognised (rows without id all stay)."""
    ruled = identify(spark, document_rows(docs), fit(docs))
    rejected = Stages(spark, "rejected").keep(ruled.filter("NOT kept").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)
