"""Missing or wrong language labels: the language of each document and of each stretch of a mixed one.

Method: prediction by partial matching. For each language a variable-order byte context tree (up to ``ORDER`` bytes of
context, escape probability of distinct over total plus distinct) is counted on a bounded sample of labelled rows and
frozen; the language of a passage is the one whose tree codes it in the fewest bits. Code is left out: fenced
blocks, inline code, declarations, tags of doc comments, identifiers and links. Sentences are coded one by one and a
document's sequence of languages is the cheapest path with ``SWITCH_BITS`` for each change of language.

The trees are held as sorted arrays: one for each order with the exact code length, in each language, of every
byte sequence seen in any, and one with the escape costs of every context. So a batch of text is scored with a
binary search for each order instead of a walk for each byte.

Training: labels are noisy, so the trees are counted twice, the second time without the sentences that the first
trees assign to another language. The sample is the ``SAMPLE_DOCS`` first rows of each language by a hash of the id,
among texts of ``SAMPLE_CHARS`` characters. All rows are scored, and whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.session import spread

ORDER = 5
SAMPLE_DOCS = 250
SAMPLE_CHARS = (80, 4000)
SWITCH_BITS = 14.0
#: The share of a text's letters outside code from which on it holds a language.
HELD_SHARE = 0.2
#: Sentences whose code lengths a Python worker keeps.
_MEMO_SENTENCES = 50_000
#: Languages that ``label_codes`` takes unless it is told otherwise.
MOST_LANGUAGES = 200

_CODE = [
    re.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*|\Z)", re.M | re.S),
    re.compile(r"`[^`\n]*`"),
    re.compile(r"https?://\S+"),
    re.compile(r"^[ \t]*(?:export |public |private |static |async |pub )*(?:function|def|func|fn|class|interface|struct|impl)\b[^\n]*[(){}:;][ \t\r]*$", re.M),
    re.compile(r"^[ \t]*(?:pass|return\b[^\n]*;?|[{}()\[\];]+)[ \t\r]*$", re.M),
    re.compile(r"@(?:param|returns?|throws|type|see)\b[^\n]*"),
    re.compile(r"^[ \t]*at \S+ \([^\n]*\)[ \t\r]*$", re.M),
    re.compile(r"^[a-z]{2,10}(?:\([^()\n]*\))?!?:(?= )", re.M | re.I),
    re.compile(r"(?<![\w$])(?:[\w$]+(?:[/\\.:_]+[\w$]+)+|\w*?[a-z0-9][A-Z]\w*)"),
]
_SENTENCE = re.compile(r"[^\n.!?。！？]+[.!?。！？]*")
_NOT_PROSE = re.compile(r"[\W\d_]+")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, letters and single blanks in lower case) of each sentence outside code that has letters."""
    for pattern in _CODE:
        text = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    found = []
    for match in _SENTENCE.finditer(text):
        words = _NOT_PROSE.sub(" ", unicodedata.normalize("NFC", match.group()).lower()).strip()
        if words:
            found.append((match.start(), match.end(), words))
    return found


def _grams(passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The last ``ORDER`` + 1 bytes up to each position as one number, the newest lowest; lengths of the passages."""
    raw = [b"\n" * ORDER + p.encode() + b"\n" for p in passages]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    gram = np.zeros(len(data), np.uint64)
    for back in range(ORDER + 1):
        gram[back:] |= data[: len(data) - back] << np.uint64(8 * back)
    lengths = np.array([len(r) - ORDER for r in raw])
    keep = np.ones(len(data), bool)
    starts = np.r_[0, np.cumsum(lengths + ORDER)[:-1]].astype(np.int64)
    for k in range(ORDER):
        keep[starts + k] = False
    return gram[keep], lengths


def _low(gram: np.ndarray, n_bytes: int) -> np.ndarray:
    return gram & np.uint64((1 << (8 * n_bytes)) - 1)


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position of each wanted key, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class ContextTrees:
    """Frozen trees of several languages."""

    def __init__(self, passages: dict[str, list[str]]):
        self.names = sorted(passages)
        n = len(self.names)
        grams = [_grams(passages[name])[0] if passages[name] else np.zeros(0, np.uint64) for name in self.names]
        self.keys: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        below_keys, below_bits = None, None
        for order in range(ORDER + 1):
            counted = [np.unique(_low(g, order + 1), return_counts=True) for g in grams]
            keys = np.unique(np.concatenate([k for k, _ in counted]))
            contexts = np.unique(keys >> np.uint64(8))
            escapes = np.zeros((len(contexts), n), np.float32)
            bits = np.zeros((len(keys), n), np.float32)
            base = np.full((len(keys), n), 8.0, np.float32) if order == 0 else below_bits[_place(below_keys, _low(keys, order))[0]]
            owner = _place(contexts, keys >> np.uint64(8))[0]
            for i, (own, counts) in enumerate(counted):
                if not len(own):
                    bits[:, i] = base[:, i]
                    continue
                at = _place(contexts, own >> np.uint64(8))[0]
                total, distinct = np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts))
                there = distinct > 0
                escapes[there, i] = -np.log2(distinct[there] / (total + distinct)[there])
                bits[:, i] = base[:, i] + escapes[owner, i]
                bits[_place(keys, own)[0], i] = -np.log2(counts / (total + distinct)[at])
            self.keys.append(keys)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escapes.append(escapes)
            below_keys, below_bits = keys, bits

    def code_lengths(self, passages: list[str]) -> np.ndarray:
        """Bits of each passage in each language."""
        if not passages:
            return np.zeros((0, len(self.names)))
        gram, lengths = _grams(passages)
        bits = np.zeros((len(gram), len(self.names)), np.float32)
        open_ = np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            at, there = _place(self.keys[order], _low(gram[open_], order + 1))
            bits[open_[there]] += self.bits[order][at[there]]
            open_ = open_[~there]
            if not len(open_):
                break
            at, there = _place(self.contexts[order], _low(gram[open_], order + 1) >> np.uint64(8))
            bits[open_[there]] += self.escapes[order][at[there]]
        bits[open_] += 8.0
        return np.add.reduceat(bits.astype(np.float64), np.r_[0, np.cumsum(lengths)[:-1]], axis=0)


def fit_trees(rows: list[tuple[str, str]]) -> ContextTrees:
    """Trees from (language, text) rows with noisy languages."""
    passages: dict[str, list[str]] = {}
    for name, text in rows:
        passages.setdefault(name, []).extend(words for _, _, words in sentences(text))
    first = ContextTrees(passages)
    kept: dict[str, list[str]] = {}
    for i, name in enumerate(first.names):
        best = first.code_lengths(passages[name]).argmin(1)
        kept[name] = [p for p, b in zip(passages[name], best, strict=True) if b == i] or passages[name]
    return ContextTrees(kept)


def cheapest_path(costs: np.ndarray, switch: float = SWITCH_BITS) -> list[int]:
    """The language number of each row of ``costs`` on the cheapest path."""
    own = costs.argmin(1)
    if (own == own[0]).all():
        return own.tolist()
    total, back = costs[0].copy(), []
    for row in costs[1:]:
        best = int(total.argmin())
        jump = total > total[best] + switch
        back.append(np.where(jump, best, np.arange(len(row))))
        total = np.where(jump, total[best] + switch, total) + row
    path = [int(total.argmin())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


class _Scorer:
    """Code lengths of sentences, with a bounded memory of repeated ones."""

    def __init__(self, trees: ContextTrees):
        self.trees, self.memo = trees, {}

    def __call__(self, passages: list[str]) -> np.ndarray:
        new = [p for p in dict.fromkeys(passages) if p not in self.memo]
        if len(self.memo) + len(new) > _MEMO_SENTENCES:
            self.memo.clear()
            new = list(dict.fromkeys(passages))
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            self.memo.update(zip(part, self.trees.code_lengths(part), strict=True))
        return np.array([self.memo[p] for p in passages]).reshape(len(passages), len(self.trees.names))


def _confidence(bits: np.ndarray, language: int) -> float:
    return float(1 / np.exp2(np.clip(bits[language] - bits, -60, 60)).sum())


def _stretches(parts: list[tuple[int, int, str]], costs: np.ndarray, names: list[str]) -> list[tuple[int, int, str, int, float]]:
    """(start, end, language, letters, confidence) of each run of sentences in one language."""
    if not parts:
        return []
    path, result, at = cheapest_path(costs), [], 0
    while at < len(parts):
        end = at
        while end < len(parts) and path[end] == path[at]:
            end += 1
        letters = sum(len(words) - words.count(" ") for _, _, words in parts[at:end])
        result.append((parts[at][0], parts[end - 1][1], names[path[at]], letters, _confidence(costs[at:end].sum(0), path[at])))
        at = end
    return result


def named_language(lang: Column | str, codes: dict[str, str]) -> Column:
    """The language that a label names: a known code, or the known name of one; else null."""
    label = F.lower(F.regexp_replace(F.regexp_replace(F.col(lang) if isinstance(lang, str) else lang, r"^\s+|\s+$", ""), r"[-_].*$", ""))
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.element_at(known, label)


def label_codes(lang_codes: DataFrame, most: int = MOST_LANGUAGES) -> dict[str, str]:
    """Codes by what may name them, in lower case: the code and the name of each language.

    Each language costs memory in every worker, so more than ``most`` are refused and not cut off; a larger number, or a
    dictionary made otherwise, lifts that.
    """
    rows = lang_codes.select("lang_code", "lang_name").filter("lang_code is not null").distinct().limit(most + 1).collect()
    if not rows or len(rows) > most:
        raise ValueError(f"between 1 and {most} languages are expected")
    names = {r.lang_name.strip().lower(): r.lang_code for r in rows if r.lang_name}
    return names | {r.lang_code.strip().lower(): r.lang_code for r in rows}


def train(documents: DataFrame, codes: dict[str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Trees from a bounded sample of the labelled rows; the sample is all that reaches the driver."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), named_language(lang_col, codes).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.length("text").between(*SAMPLE_CHARS))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    rows = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= SAMPLE_DOCS)
    got = [(r.lang, r.text) for r in rows.select("lang", "text").collect()]
    if not got:
        return ContextTrees({code: [] for code in set(codes.values())})
    return fit_trees(sorted(got))


def language_stretches(documents: DataFrame, lang_codes: DataFrame | dict[str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, start, end, lang_code, letters, confidence): each run of sentences of a text in one language.

    start and end are character positions in the text. Null, empty and blank texts, and texts without letters outside
    code, give no row. Rows without a usable label are scored like all others; a language without any labelled row is
    never assigned. Repeated rows give repeated results. Labels don't influence a row's result otherwise than as one
    of the sample. Nothing is shuffled but the sample; the trees are broadcast, their size is bounded by the sample.
    """
    codes = lang_codes if isinstance(lang_codes, dict) else label_codes(lang_codes)
    trees = documents.sparkSession.sparkContext.broadcast(train(documents, codes, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(trees.value)
        for batch in batches:
            parsed = [sentences(text) if text else [] for text in batch.column(1).to_pylist()]
            costs = score([words for parts in parsed for _, _, words in parts])
            of, rows, at = [], [], 0
            for i, parts in enumerate(parsed):
                found = _stretches(parts, costs[at : at + len(parts)], trees.value.names)
                at += len(parts)
                of += [i] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64())
            arrays = [batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "end", "lang_code", "letters", "confidence"])

    kind = documents.schema[id_col].dataType.simpleString()
    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, start bigint, end bigint, lang_code string, letters bigint, confidence double")


def held_languages(stretches: DataFrame, id_col: str = "doc_id", share: float = HELD_SHARE) -> DataFrame:
    """Rows (doc_id, lang_code, share, confidence): the languages with at least ``share`` of a document's letters.

    confidence is the mean over the language's letters.
    """
    by = stretches.groupBy(id_col, "lang_code").agg(F.sum("letters").alias("n"), (F.sum(F.col("letters") * F.col("confidence")) / F.sum("letters")).alias("confidence"))
    by = by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(id_col)))
    return by.filter(F.col("share") >= share).select(id_col, "lang_code", "share", "confidence")


def wrong_labels(documents: DataFrame, lang_codes: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, lang_code) of the documents whose held languages aren't exactly the one that the label names."""
    codes = label_codes(lang_codes)
    held = held_languages(language_stretches(documents, codes, id_col, text_col, lang_col), id_col)
    held = held.groupBy(id_col).agg(F.array_sort(F.collect_set("lang_code")).alias("held"))
    labels = documents.select(id_col, named_language(lang_col, codes).alias("named")).distinct()
    wrong = held.join(labels, id_col).filter(F.col("named").isNull() | (F.col("held") != F.array("named")))
    return wrong.select(id_col, F.explode("held").alias("lang_code")).distinct()
