"""Language identification by Bayesian evidence fusion.

For each row the log posterior of a language adds up
  - the tempered log likelihood of its whole text under that language's letter trigrams,
  - log P(declared language | language) and log P(address suffix | language), estimated
    from grouped counts over all rows,
  - log prior of the language on its host, smoothed towards its domain and that towards
    all rows, from grouped sums over all other rows.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.llm import scratch

BUCKETS = 1 << 16
#: Neighbouring trigrams repeat each other: a text counts as this share of its trigrams, MAX_GRAMS at most.
TEMPER, MAX_GRAMS = 0.3, 200.0
#: Rows that a domain's, and a host's, smoothing counts for.
DOMAIN_ROWS, HOST_ROWS = 20.0, 10.0
#: What no language's text looks like: this many nats a trigram below the poorest language's own texts.
UNKNOWN, UNKNOWN_NATS, UNKNOWN_PRIOR = "und", 3.0, 1e-3
NONE, OTHER = "-", "other"

# Country suffixes and the language that most addresses under them have.
COUNTRY = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "uk": "en", "us": "en", "au": "en", "ie": "en",
    "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "se": "sv", "dk": "da", "no": "no", "fi": "fi",
}

_OPEN = re.compile(r"(?i)<(?:(!--)|(script|style)\b)")
_CLOSE = {"!--": re.compile("-->"), "script": re.compile(r"(?i)</script\s*+>"), "style": re.compile(r"(?i)</style\s*+>")}
_TAG = re.compile(r"<[^>]*>")


def visible(page: str) -> str:
    """Text of a page without scripts, styles, comments and tags, in one pass; what is never closed stays."""
    out, copied, at, unclosed = [], 0, 0, set()
    while m := _OPEN.search(page, at):
        kind, at = m[1] or m[2].lower(), m.end()
        end = None if kind in unclosed else _CLOSE[kind].search(page, at)
        if end is None:
            unclosed.add(kind)  # nor is any later one
            continue
        out += [page[copied : m.start()], " "]
        copied = at = end.end()
    rest = "".join([*out, page[copied:]])
    last = rest.rfind(">") + 1  # no tag ends behind it
    return html_entities.unescape(_TAG.sub(" ", rest[:last]) + rest[last:])


def trigrams(text: str) -> np.ndarray:
    """Buckets of all letter trigrams of a whole text; runs of anything else are one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where((c >= 97) & (c <= 122) | (c >= 0xC0), c, 32)
    if len(c):
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    c = np.concatenate(([32], c, [32]))
    h = (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) * 2654435761
    return (h >> 12) % BUCKETS if (c != 32).any() else np.zeros(0, np.int64)


class Model:
    """languages, and log probabilities of trigram buckets: one row a bucket, one column a language, the unknown last."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def log_likelihood(self, text: str) -> tuple[np.ndarray, int]:
        g = trigrams(text)
        return self.table[g].sum(0, dtype=np.float64) if len(g) else np.zeros(self.table.shape[1]), len(g)


def train(texts: list[str], languages: list[str]) -> Model:
    names = sorted(set(languages))
    counts = np.zeros((BUCKETS, max(1, len(names))))
    for t, lang in zip(texts, languages):
        counts[:, names.index(lang)] += np.bincount(trigrams(t or ""), minlength=BUCKETS)
    return _model(names, counts)


def _model(names: list[str], counts: np.ndarray) -> Model:
    """From trigram counts, one row a bucket and one column a language."""
    names = names or ["en"]
    p = np.log((counts + 0.05) / (counts + 0.05).sum(0))
    own = (p * counts).sum(0) / np.maximum(counts.sum(0), 1)  # mean log probability of each one's texts
    floor = np.full((BUCKETS, 1), (own[own < 0].min() if (own < 0).any() else -8.0) - UNKNOWN_NATS)
    return Model([*names, UNKNOWN], np.concatenate([p, floor], 1).astype(np.float32))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of every language that labelled rows name, from the trigrams of all their whole texts.

    Tasks add up a count for each language and bucket they meet, which are then summed;
    the driver gets BUCKETS rows a language at most, whatever the number of texts.  The
    names that stand for no language here (UNKNOWN, OTHER, NONE) are no labels.
    """
    ship(docs.sparkSession)
    known = docs.select(F.lower(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & ~F.col("lang").isin(UNKNOWN, OTHER, NONE) & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in scratch.tidied(batches):
            for lang, text in zip(b.column(0), b.column(1)):
                mine = counts.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                mine += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            at = at if len(at) else np.zeros(1, np.int64)  # a language without a letter is one too
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    got = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(got["lang"].unique().to_pylist())
    counts = np.zeros((BUCKETS, max(1, len(names))))
    for k, name in enumerate(names):
        mine = got.filter(pc.equal(got["lang"], name))
        counts[mine["bucket"].to_numpy(), k] = mine["n"].to_numpy()
    return _model(names, counts)


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix language): the last from a path segment or host label of two letters, or a country suffix."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    domain = F.regexp_extract(F.substring_index(host, ".", -2), r"^([^.]+\.[^.]+)$", 1)
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    label = F.regexp_extract(host, r"^([a-z]{2})\.", 1)
    table = F.create_map(*[F.lit(x) for kv in COUNTRY.items() for x in kv])
    country = F.try_element_at(table, F.substring_index(host, ".", -1))
    said = F.coalesce(F.nullif(path, F.lit("")), F.nullif(label, F.lit("")), country, F.lit(NONE))
    return host, F.when(domain == "", host).otherwise(domain), said


def declared_language(page: Column) -> Column:
    """Primary tag of the html element's lang attribute, lower case; NONE without one."""
    tag = F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<html\b([^<>]*+)>", 1)
    value = F.lower(F.regexp_extract(tag, r"""(?is)(?:^|\s)(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b""", 1))
    return F.when(value == "", NONE).otherwise(value)


def text_evidence(rows: DataFrame, model: Model, is_html: bool, keep: list[str]) -> DataFrame:
    """keep columns with n_grams, ll (tempered log likelihoods, best 0) and p (their softmax) of the column ``text``."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one float a language
    schema = rows.select(*keep).schema
    text_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", n_grams long, ll array<double>, p array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in scratch.tidied(batches):
            n, ll = [], []
            for t in b.column(b.num_columns - 1):
                text = t.as_py() or ""
                got, grams = m.log_likelihood(visible(text) if is_html else text)
                n.append(grams)
                ll.append(got * (min(grams * TEMPER, MAX_GRAMS) / max(grams, 1)))
            x = np.array(ll).reshape(len(n), -1)
            x = x - x.max(1, keepdims=True) if len(n) else x
            p = np.exp(x)
            p /= p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(p.tolist(), pa.list_(pa.float64()))],
                names=[*keep, "n_grams", "ll", "p"],
            )

    return rows.select(*keep, "text").mapInArrow(run, text_schema)


def _table(rows: DataFrame, evidence: str, languages: list[str]) -> Column:
    """Map from a value of the evidence to log P(value | language), from counts over all rows with text."""
    n = len(languages)
    top = F.array_position("p", F.array_max("p")) - 1
    counted = rows.where("n_grams > 0").groupBy(top.alias("lang"), F.col(evidence).alias("value")).count().collect()
    values = [*languages[:-1], OTHER, NONE]
    c = np.full((len(values), n), 0.5)
    for i in range(n - 1):
        c[i, i] += 2.0  # a value most likely means what it says
    for r in counted:  # at most (languages + 2) * languages rows
        c[values.index(r["value"]), int(r["lang"])] += r["count"]
    logs = np.log(c / c.sum(0))
    logs[:, -1] = np.log(c.sum(1) / c.sum())  # nothing is known of the unknown
    return F.create_map(*[x for v, row in zip(values, logs.tolist()) for x in (F.lit(v), F.array(*[F.lit(y) for y in row]))])


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """rows (host, domain, declared, suffix, n_grams, ll, p, ...) with lang, confidence and posterior.

    declared and suffix must be among the languages, OTHER or NONE.  A row's own
    evidence is taken out of its host's and domain's sums.  Hosts are aggregated before
    they are joined, and a hot host's rows are split by the skew join.
    """
    n = len(languages)
    zeros = F.array(*[F.lit(0.0)] * n)
    weight = F.when(F.col("n_grams") > 0, 1.0).otherwise(0.0)
    sums = [F.sum(F.col("p")[i] * weight).alias(f"s{i}") for i in range(n)]
    hosts = rows.groupBy("host", "domain").agg(*sums)
    totals = hosts.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).first()
    everywhere = np.array([totals[i] or 0.0 for i in range(n)]) + 1.0
    share = everywhere / everywhere.sum() * (1 - UNKNOWN_PRIOR)
    share[-1] = UNKNOWN_PRIOR
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(f"s{i}") for i in range(n)]).alias("in_domain"))
    hosts = hosts.select("host", "domain", F.array(*[f"s{i}" for i in range(n)]).alias("on_host")).join(domains, "domain")
    hosts = scratch.save(hosts, "hosts")  # a table of its own, so that a hot host's rows can be split in the join below
    tables = [_table(rows, e, languages) for e in ("declared", "suffix")]
    own = F.transform("p", lambda x: x * weight)

    def less(sums: Column, mine: Column) -> Column:
        return F.zip_with(sums, mine, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(counts: Column, base: Column, rows: float) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + rows
        return F.zip_with(counts, base, lambda c, q: (c + F.lit(rows) * q) / total)

    def added(*arrays: Column) -> Column:
        out = arrays[0]
        for a in arrays[1:]:
            out = F.zip_with(out, a, lambda x, y: x + y)
        return out

    got = rows.join(hosts, ["host", "domain"], "left")
    got = got.withColumn("__own", own).withColumn("__domain", less(F.coalesce("in_domain", zeros), F.col("__own")))
    got = got.withColumn("__host", less(F.coalesce("on_host", zeros), F.col("__own")))
    got = got.withColumn("__base", smoothed(F.col("__domain"), F.array(*[F.lit(float(x)) for x in share]), DOMAIN_ROWS))
    got = got.withColumn("prior", smoothed(F.col("__host"), F.col("__base"), HOST_ROWS))
    said = [F.coalesce(F.try_element_at(t, F.col(e)), F.try_element_at(t, F.lit(OTHER))) for t, e in zip(tables, ("declared", "suffix"))]
    got = got.withColumn("__log", added(F.col("ll"), F.transform("prior", lambda x: F.log(F.greatest(x, F.lit(1e-9)))), *said))
    got = got.withColumn("__exp", F.transform("__log", lambda x: F.exp(x - F.array_max("__log"))))
    got = got.withColumn("posterior", F.transform("__exp", lambda x: x / F.aggregate("__exp", F.lit(0.0), lambda a, y: a + y)))
    names = F.array(*[F.lit(x) for x in languages])
    got = got.withColumn("confidence", F.array_max("posterior"))
    got = got.withColumn("lang", F.element_at(names, F.array_position("posterior", F.col("confidence")).cast("int")))
    return got.drop("__own", "__domain", "__host", "__base", "__log", "__exp", "in_domain", "on_host")


def _among(value: Column, languages: list[str]) -> Column:
    return F.when(value.isin([*languages[:-1], NONE]), value).when(value.isNull(), NONE).otherwise(OTHER)


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, lang, confidence, text_lang, declared, suffix, host, n_grams, posterior), one row per page.

    Null pages and pages without letters have no text evidence (text_lang null) and go
    by the rest; a null address has an empty host, null ids pass, repeated rows give a
    row each; an empty table gives an empty result; other columns are ignored.
    """
    host, domain, suffix = address_parts(F.col(url_col).cast("string"))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), host.alias("host"), domain.alias("domain"),
        _among(declared_language(F.col(html_col).cast("string")), model.languages).alias("declared"),
        _among(suffix, model.languages).alias("suffix"), F.col(html_col).cast("string").alias("text"),
    )
    rows = scratch.save(text_evidence(rows, model, True, ["id", "host", "domain", "declared", "suffix"]), "language")
    return _shaped(fuse(rows, model.languages), model)


def _shaped(got: DataFrame, model: Model) -> DataFrame:
    names = F.array(*[F.lit(x) for x in model.languages])
    text = F.when(F.col("n_grams") > 0, F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))
    return got.withColumn("text_lang", text)


def keep_known(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without those whose language remains unknown; their column lang is the declared language, their source the host.

    A row goes only if its text fits no language; empty texts stay.  Rejected rows are
    found by id and a hash of the text, so a repeated id doesn't take others along.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), key.alias("key"), source.alias("host"), F.lit("").alias("domain"),
        _among(F.lower(F.col(lang_col).cast("string")), model.languages).alias("declared"), F.lit(NONE).alias("suffix"),
        F.col(text_col).cast("string").alias("text"),
    )
    rows = scratch.save(text_evidence(rows, model, False, ["id", "key", "host", "domain", "declared", "suffix"]), "language")
    bad_id, bad_key = scratch.fresh(docs, "id"), scratch.fresh(docs, "key")
    bad = fuse(rows, model.languages).where((F.col("lang") == UNKNOWN) & (F.col("n_grams") > 0)).select(F.col("id").alias(bad_id), F.col("key").alias(bad_key)).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(bad_id)) & (key == F.col(bad_key)), "left_anti")
