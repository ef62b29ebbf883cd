"""Missing or wrong document language labels (problem 10).

Each sentence gets a likelihood per language from character n-grams, and this text evidence is fused by Bayes' rule
with the declared label, the language named in the path, and a prior of the host: label counts by repository,
smoothed towards those of its source, and these towards those of the corpus, all by grouped aggregation.

The n-gram model (``BUCKETS`` x languages, a fixed size) is fitted on a bounded sample of the labelled
documents, at most about ``per_language`` for each language, taken by a hash of doc_id; a second fit uses the
sample's sentences under the languages that the first one gave them, so that wrong labels wash out.
Label counts cover all documents, and every sentence of every document is scored.

What is no sentence does not count: fenced blocks, headings, lines without an end mark, code spans,
identifiers, paths and quotations. A document with confident sentences in several languages is multilingual and
gives a row for each paragraph and language; any other gives one row with paragraph -1.

Edge cases: null, empty and blank texts and texts without a sentence give no row; a null, blank or unknown
label is no evidence; labels of languages outside ``languages`` are evidence against none of them; a text that is far less likely
than any in ``languages`` keeps such a label, with the trust in labels as confidence, or is ``und`` with confidence 0 without one (a language whose
n-grams are like those of a modelled one, as Danish beside Swedish, is taken for that one); null repository,
source or path give the next wider prior; equal posteriors fall to the language earlier in the list; very long
texts are scored in slices of bounded size; without any labelled document the model rests on its seed words.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.documents import spread
from palimpsest.session import discard, materialize

#: Common words of each language, the seed of its model.
SEED_WORDS = {
    "en": "the of and to in that is was for it with as on be by this are from at or which not have",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas",
    "it": "di e il la che in a per un del è una con non sono da al le si dei nel alla più",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij",
    "ru": "и в не на что с по это как а но он она они из у за от так же для только мы вы",
    "pl": "i w nie na się że z do to jest o jak a ale po co tak za od przez dla czy już",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など ます です",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出",
    "sv": "och i att det som en på är av för med till den har de inte om ett han men var jag",
}
#: ISO 639-2 codes of the bibliographic kind, where they differ from the terminological ones.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}
LANGUAGES = list(SEED_WORDS)
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
#: Overlapping n-grams are not independent; their log-likelihoods are scaled by this.
TEMPER = 0.1
#: Chance that a stated label (or a path's language) is right.
LABEL_TRUST, PATH_TRUST = 0.85, 0.9
#: Posterior that a sentence needs to make a document multilingual.
CONFIDENT = 0.95
SMOOTHING = 20.0
#: How far, in log-likelihood per n-gram, a text may fall below the fitted ones before it is in none of the modelled languages. On the
#: test tables fitted texts lie within 1 of their mean, ordinary prose of other fields within 3, and Czech, Finnish, Turkish and Korean from 4 on.
FOREIGN = 3.7
#: ISO 639 code of a text in no language that is modelled or named.
UNDETERMINED = "und"
#: Rows of host counts (about 350 bytes each) up to which they are broadcast.
BROADCAST_HOSTS = 50_000
#: Characters scored at a time: the bound of the scoring matrix.
SLICE = 100_000


def label_codes(spark: SparkSession) -> dict[str, str]:
    """Lower-case two- and three-letter codes and English names to two-letter codes, from the JVM's ISO table."""
    locale = spark.sparkContext._jvm.java.util.Locale
    known: dict[str, str] = dict(BIBLIOGRAPHIC)
    english = locale.forLanguageTag("en")
    for code in locale.getISOLanguages():
        one = locale.forLanguageTag(code)
        for name in (code, one.getISO3Language(), one.getDisplayLanguage(english)):
            known.setdefault(name.lower(), code)
    return known


def canonical_label(label: str | None, known: dict[str, str]) -> str | None:
    """The two-letter code that a label names, in any usual spelling; None if it names none."""
    if label is None:
        return None
    text = label.strip().lower()
    return known.get(text) or known.get(regex.split(r"[-_ .@;,(/]", text)[0])


def _lookup(table: dict[str, int]) -> Column:
    """A literal map; lookups of absent keys give null."""
    return F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])


def _label_index(c: Column, known: dict[str, str], languages: list[str]) -> Column:
    """JVM form of canonical_label, as a position in ``languages``; null for all else."""
    names = _lookup({n: languages.index(to) for n, to in known.items() if to in languages})
    text = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(names, text), F.try_element_at(names, F.split(text, r"[-_ .@;,(/]")[0]))


def _path_index(path: Column, languages: list[str]) -> Column:
    """A language named in a path: ``name.de.md`` or a folder ``/de/``."""
    part = F.lower(F.regexp_extract(path, r"(?i)(?:\.|/|^)([a-z]{2})(?:[-_][a-z]{2,4})?(?:\.[a-z]+$|/)", 1))
    return F.try_element_at(_lookup({code: i for i, code in enumerate(languages)}), part)


# --- Sentences -----------------------------------------------------------------------------------------------

_QUOTED = regex.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|`+[^`\n]*`+')
_BRACKET = regex.compile(r"\[[^\]\n]*\]|\([^()\n]*\)|<[^<>\n]*>")
_CODE_WORD = regex.compile(r"[\p{L}\p{N}_./:\\\-]*[A-Za-z0-9_][_/\\:.][A-Za-z0-9_][A-Za-z0-9_./:\\\-]*|\b\w*\d\w*\b|\b[a-z]+\p{Lu}\w*\b|\b(?:\p{Lu}[a-z0-9]+){2,}\b|--\w+")
#: Ends of sentences, and of lines.
_END = re.compile(r"(?<=[.!?…])(?=\s|$)|(?<=[。！？])|\n")
_MARKS = frozenset(".!?…。！？")
_MARKER = re.compile(r"^[^\S\n]*(?:(?:///?!?|//!|#!|\*+|/\*+!?|-|\+|•|>+|\d+[.)])[^\S\n]+)+")
_CODELIKE = re.compile(r"[{};=]|->|::")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_FENCE = regex.compile(r"^\s*(```+|~~~+)(?!.*\1)")
#: What a line must hold for the patterns above to find anything; most lines have nothing of it.
_MAY_QUOTE = re.compile(r'["“„«「『`]')
_MAY_BRACKET = re.compile(r"[\[(<]")
_MAY_CODE = re.compile(r"[\d_/\\:]|\.[A-Za-z0-9_]|--\w")
_CAMEL = regex.compile(r"[a-z]\p{Lu}")
#: A line of its own that begins a paragraph.
_PARAGRAPH = "\0"


def sentences(text: str | None) -> list[tuple[int, str]]:
    """(paragraph, words in lower case with spaces around) of each sentence that counts.

    Patterns go over a line only where it holds what they look for; sentences of all kept lines are split at once.
    """
    if not text:
        return []
    text = unicodedata.normalize("NFC", text)
    if "\0" in text:
        text = text.replace("\0", " ")
    kept, blank, fenced = [], True, False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        bare = line.lstrip()
        if not bare:
            blank = True
            continue
        if blank:
            kept.append(_PARAGRAPH)
            blank = False
        if bare[0] in "`~" and _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or bare[0] == "#":
            continue
        if not bare[0].isalpha():
            line = _MARKER.sub("", line)
        if _MAY_QUOTE.search(line):
            line = _QUOTED.sub(" ", line)
        if _MAY_BRACKET.search(line):
            line = _BRACKET.sub(" ", line)
        if _MAY_CODE.search(line) or _CAMEL.search(line):
            # Words of code hold no white space.
            line = " ".join([_CODE_WORD.sub(" ", w) if _MAY_CODE.search(w) or _CAMEL.search(w) else w for w in line.split(" ")])
        kept.append(line)
    out, paragraph = [], -1
    for piece in _END.split("\n".join(kept)):
        if piece == _PARAGRAPH:
            paragraph += 1
            continue
        bare = piece.rstrip()
        if not bare or bare[-1] not in _MARKS or _CODELIKE.search(piece):
            continue
        words = _LETTERS.findall(piece.lower())
        if len(words) >= 2 or len(_CJK.findall(piece)) >= 4:
            out.append((paragraph, " " + " ".join(words) + " "))
    return out


# --- N-grams ---------------------------------------------------------------------------------------------------


def _grams(texts: list[str]):
    """For each order: bucket of the n-gram at every place of the joined texts, -1 where it would cross a border; the starts."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    border = codes == 10
    rolled, crossing = np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
    for n in ORDERS:
        shifted, edge = np.zeros_like(codes), np.ones(len(codes), bool)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        edge[: len(codes) - n + 1] = border[n - 1 :]
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
        crossing = crossing | edge
        h = rolled ^ (rolled >> np.uint64(29))
        h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(47)
        yield np.where(crossing, -1, (h % np.uint64(BUCKETS)).astype(np.int64)), starts


def _slices(texts: list[str]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= SLICE:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def score(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Tempered log-likelihoods, one row per text. ``model`` has a last row of zeros for no n-gram."""
    out = []
    for part in _slices(texts):
        total = np.zeros((len(part), model.shape[1]), np.float64)
        for h, starts in _grams(part):
            total += np.add.reduceat(model[h], starts, axis=0)
        out.append(total)
    return TEMPER * np.concatenate(out) if out else np.zeros((0, model.shape[1]))


class Model(NamedTuple):
    """Log-probabilities of n-gram buckets by language, with the row of zeros that index -1 finds, and the mean
    log-likelihood of an n-gram of the fitted texts under their own language, each left out of its own count. The fewer the texts, the
    lower that is, so that a model that knows little calls nothing foreign."""

    weights: np.ndarray
    typical: float


def fit(counts: np.ndarray) -> Model:
    p = counts + 0.05
    whole = p.sum(axis=0, keepdims=True)
    others = np.log(np.maximum(p - 1, 0.05) / (whole - 1))
    p = np.log(p / whole)
    return Model(np.vstack([p, np.zeros((1, p.shape[1]))]).astype(np.float32), float((counts * others).sum() / max(counts.sum(), 1.0)))


def _seed_counts(languages: list[str]) -> np.ndarray:
    counts = np.zeros((BUCKETS, len(languages)))
    for i, code in enumerate(languages):
        for h, _ in _grams([f" {w} " for w in SEED_WORDS[code].split()]):
            np.add.at(counts[:, i], h[h >= 0], 1.0)
    return counts


def sampled_sentences(rows: DataFrame) -> DataFrame:
    """(sentences, label) of (text, label) rows, written once for both fits."""

    def split(batches):
        for batch in batches:
            found = [[s for _, s in sentences(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column("label")], names=["sentences", "label"])

    return materialize(spread(rows.select("text", "label")).mapInArrow(split, "sentences array<string>, label int"), "sentences")


def _counted(rows: DataFrame, languages: list[str], model=None) -> np.ndarray:
    """N-gram counts by language of (sentences, label index) rows: by label, or by a shared model's verdict.

    Counts are summed within each batch and then by a grouped aggregation; at most BUCKETS x languages
    cells, a fixed number, come to the driver.
    """

    def count(batches):
        for batch in batches:
            texts, langs = [], []
            for found, label in zip(batch.column("sentences").to_pylist(), batch.column("label").to_pylist()):
                texts += found
                langs += [label] * len(found)
            if not texts:
                continue
            if model is not None:
                m = model.value
                s = score(texts, m.weights)
                order = np.sort(s, axis=1)
                sure = order[:, -1] - order[:, -2] > 3.0
                langs = np.where(sure, s.argmax(axis=1), -1).tolist()
            cells: dict[int, int] = {}
            at = 0
            for part in _slices(texts):
                lang = np.array(langs[at : at + len(part)])
                at += len(part)
                owner = np.repeat(lang, [len(t) + 1 for t in part])
                for h, _ in _grams(part):
                    ok = (h >= 0) & (owner >= 0)
                    keys, n = np.unique(h[ok] * len(languages) + owner[ok], return_counts=True)
                    for k, c in zip(keys.tolist(), n.tolist()):
                        cells[k] = cells.get(k, 0) + c
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(cells), pa.int64()), pa.array(list(cells.values()), pa.int64())], names=["cell", "n"]
            )

    got = spread(rows).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros((BUCKETS, len(languages)))
    table = got.toArrow()
    cells = table.column("cell").to_numpy()
    out[cells // len(languages), cells % len(languages)] = table.column("n").to_numpy()
    return out


def train(documents: DataFrame, languages: list[str] = LANGUAGES, per_language: int = 1000) -> Model:
    """The n-gram model, from about ``per_language`` labelled documents of each language at most."""
    known = label_codes(documents.sparkSession)
    rows = documents.select("doc_id", "text", _label_index(F.col("lang"), known, languages).alias("label")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per language
    part = F.lit(0.0)
    for i, n in sizes.items():
        part = F.when(F.col("label") == i, min(1.0, per_language / n)).otherwise(part)
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = sampled_sentences(rows.where(place < part))
    seed = _seed_counts(languages)
    first = documents.sparkSession.sparkContext.broadcast(fit(seed + _counted(sample, languages)))
    model = fit(seed + _counted(sample, languages, first))
    discard(sample)
    return model


# --- Fusion ----------------------------------------------------------------------------------------------------


def host_counts(labels: DataFrame, width: int) -> DataFrame:
    """(h, hs, n, n_source, n_all) from (repository_id, source, label): label counts of each host (h in source hs),
    of its source and of the corpus. Grouped upwards from the hosts' counts, so the documents are grouped once.
    """
    one = [F.sum(F.when(F.col("label") == i, 1).otherwise(0)).cast("double") for i in range(width)]
    counts = labels.groupBy(F.col("repository_id").alias("h"), F.col("source").alias("hs")).agg(F.array(*one).alias("n"))
    by_source = counts.groupBy(F.col("hs").alias("s")).agg(F.array(*[F.sum(F.col("n")[i]) for i in range(width)]).alias("n_source"))
    corpus = by_source.agg(*[F.sum(F.col("n_source")[i]).alias(str(i)) for i in range(width)]).first()
    n_all = F.array(*[F.lit(float(corpus[i] or 0.0)) for i in range(width)])
    return counts.join(by_source, F.col("hs").eqNullSafe(F.col("s")), "left").select("h", "hs", "n", "n_source", n_all.alias("n_all"))


def smoothed(counts: np.ndarray, wider: np.ndarray) -> np.ndarray:
    """Shares of rows of counts, drawn towards the wider ones as if these had been seen SMOOTHING times."""
    return (counts + SMOOTHING * wider) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)


SEGMENTS = "doc_id {}, paragraph int, lang string, confidence double, sentences int, declared string, multilingual boolean"


def assign(
    documents: DataFrame, languages: list[str] = LANGUAGES, model: Model | None = None, per_language: int = 1000
) -> DataFrame:
    """(doc_id, paragraph, lang, confidence, sentences, declared, multilingual): -1 for a document as a whole,
    a row per paragraph and language for a multilingual one."""
    spark = documents.sparkSession
    known = label_codes(spark)
    if model is None:
        model = train(documents, languages, per_language)
    shared = spark.sparkContext.broadcast((model, known))
    d = documents.select("doc_id", "text", "lang", "source", "repository_id", "path").where(F.col("text").isNotNull())
    d = d.withColumn("label", _label_index(F.col("lang"), known, languages))
    hosts = materialize(host_counts(d.select("label", "source", "repository_id"), len(languages)), "hosts")
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)  # else a join that shuffles the texts once
    d = d.join(hosts, F.col("repository_id").eqNullSafe(F.col("h")) & F.col("source").eqNullSafe(F.col("hs")), "left").select(
        "doc_id", "text", "lang", "n", "n_source", "n_all", "label", _path_index(F.col("path"), languages).alias("suffix")
    )
    kind = documents.schema["doc_id"].dataType.simpleString()

    def verdicts(batches):
        m, names = shared.value
        for batch in batches:
            yield _verdicts(batch, m, names, languages)

    return spread(d).mapInArrow(verdicts, SEGMENTS.format(kind))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _trusts(right: float, width: int) -> np.ndarray:
    """Log-evidence of a statement by the language that it names; the last row is that of no statement."""
    out = np.full((width + 1, width), np.log((1 - right) / (width - 1)))
    np.fill_diagonal(out, np.log(right))
    out[width] = 0.0
    return out


def _counts(column: pa.Array, width: int) -> np.ndarray:
    """Rows of counts; none where the row is null, which leaves the wider prior as it is."""
    out = np.zeros((len(column), width))
    held = np.asarray(column.is_valid())
    if held.any():
        out[held] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _verdicts(batch: pa.RecordBatch, model: Model, known: dict[str, str], languages: list[str]) -> pa.RecordBatch:
    width, col = len(languages), batch.column
    found = [sentences(t) for t in col("text").to_pylist()]
    docs = np.array([i for i, f in enumerate(found) if f], np.int64)
    rows: list[tuple] = []
    if len(docs):
        host = np.full((batch.num_rows, width), 1.0 / width)
        for level in ("n_all", "n_source", "n"):
            host = smoothed(_counts(col(level), width), host)
        stated = lambda c: col(c).fill_null(width).to_numpy(zero_copy_only=False).astype(np.int64)
        prior = (np.log(host) + _trusts(LABEL_TRUST, width)[stated("label")] + _trusts(PATH_TRUST, width)[stated("suffix")])[docs]
        texts = [s for f in found for _, s in f]
        mine = score(texts, model.weights)
        sizes = np.array([len(found[i]) for i in docs])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        whole = _softmax(np.add.reduceat(mine, starts, axis=0) + prior)
        # A sentence's prior is half the document's and half none, since sentences may differ from their document.
        own = np.log(0.5 * _softmax(prior) + 0.5 / width)
        each = _softmax(mine + np.repeat(own, sizes, axis=0))
        lang = np.where(each.max(axis=1) >= CONFIDENT, each.argmax(axis=1), -1)
        several = np.logical_or.reduceat(lang[:, None] == np.arange(width), starts, axis=0).sum(axis=1)
        # Each sentence at its best: what is far less likely than any text of the modelled languages is none of them: the label stands, or it
        # stays undetermined.
        lengths = np.array([len(s) for s in texts])
        grams = len(ORDERS) * np.add.reduceat(lengths, starts) - sizes * sum(n - 1 for n in ORDERS)
        foreign = np.add.reduceat(mine.max(axis=1), starts) / TEMPER / grams < model.typical - FOREIGN
        main, labels = whole.argmax(axis=1), col("lang").to_pylist()
        for k, i in enumerate(docs.tolist()):
            declared = canonical_label(labels[i], known)
            if foreign[k]:
                other = declared if declared is not None and declared not in languages else UNDETERMINED
                rows.append((i, -1, other, LABEL_TRUST if other == declared else 0.0, int(sizes[k]), declared, False))
                continue
            if several[k] < 2:
                rows.append((i, -1, languages[main[k]], float(whole[k, main[k]]), int(sizes[k]), declared, False))
                continue
            # An unsure sentence takes the best of the languages that the document surely has.
            part = slice(starts[k], starts[k] + sizes[k])
            post, sure = each[part], lang[part]
            held = sorted(set(sure[sure >= 0].tolist()))
            sure = np.where(sure >= 0, sure, np.array(held)[post[:, held].argmax(axis=1)])
            groups: dict[tuple[int, int], list[float]] = {}
            for (p, _), code, of in zip(found[i], sure.tolist(), post):
                groups.setdefault((p, code), []).append(float(of[code]))
            for (p, code), c in sorted(groups.items()):
                rows.append((i, p, languages[code], sum(c) / len(c), len(c), declared, True))
    take = pa.array([r[0] for r in rows], pa.int64())
    kinds = [pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.bool_()]
    columns = [col("doc_id").take(take), *[pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(kinds)]]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "paragraph", "lang", "confidence", "sentences", "declared", "multilingual"])


def mislabelled(assigned: DataFrame) -> DataFrame:
    """(doc_id, paragraph, lang): multilingual paragraphs, and documents whose label is missing or names another language."""
    wrong = F.col("declared").isNull() | (F.col("declared") != F.col("lang"))
    return assigned.where(F.col("multilingual") | wrong).select("doc_id", "paragraph", "lang")
