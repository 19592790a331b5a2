"""Text quality by line labels: a hidden Markov model over line statistics, and the shares of its labels per document.

A document's lines (long ones in stretches) are observations of statistics in bins; each state
belongs to one of the labels prose, list, table, code and junk. Emissions and transitions are fitted by expectation-maximisation on a bounded sample of judged
documents, of which only the label of the whole is known: it favours its states on every line without forcing them. A few
example lines of each state, given below, stand for a prior, so that the model is sound with few or no judged samples.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.runtime import drawn

STATES = ("prose", "list", "table", "code", "junk")
#: Bound of the fitting sample: judged documents, which are fitted on whole.
MAX_JUDGED = 3000
#: Lines, padding included, that go through the recursion together.
TOGETHER = 8192
#: Characters of a line that are one observation.
STRETCH = 400
ROUNDS = 6

# Frequent words of European languages.
_COMMON = frozenset(
    """the of and a to in is that it was for on are as with his they at be this have from or had by not but what all were when we there can an your
    which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make
    than been its who now did get may part over such our only also any after most where why did does because while before until although however even
    every both once still here must very should just those i'm it's don't isn't i you he my me us
    der die das und ist nicht ein eine einen einem einer den dem des zu mit von auf für im in es sich wir sie er ich aber auch wie als wenn so bei nach nur noch
    war hat haben wird werden kann dass warum oder an am zum zur über unter vor seit bis dann ohne mehr man uns ihr ihre sein seine
    le la les un une des du de et est que qui ne pas dans pour sur il elle nous vous ils on au aux ce cette ces se sa son ses par plus avec mais ou où y a été
    était sont avons pourquoi quand comme sans tout rien si bien même après depuis
    el los las una unos y que no se por con para su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde
    quien desde todo nos durante ni del es son hemos ha cuanto nadie
    o os as um uma e do da dos das em no na nos nas não com por mais que se para ele ela isso mas quando muito foi ser tem são está pelo pela até sem
    já também só seu sua nem depois como ninguém quantas
    il lo gli di che è per non con del della sono come più anche ma dei nel alla questo
    het een van en dat niet te zijn met voor aan er ook als maar om bij nog uit
    och att det som på är av för med den till inte om ett har de
    i w na z do nie się to że jest o jak po co tak ale od przez dla
    и в не на что с по как это от за из но к у же для так бы все он мы
    ve bir bu da için ile ne""".split()
)
# Frequent function characters of Chinese, Japanese and Korean.
_EAST = frozenset("的了是在不就我他这那有和也都会要从们为什么如果但没之过还被把让着对到得与及其或而且吗呢吧はがをにでもとのかへだろうこれますしたはいなけ은는이가을를에의도로다")
_BREAKS = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STOP = re.compile(r"[.!?。！？…][\"'”’»)\]]*(?=\s|$|[぀-鿿])")
_BULLET = re.compile(r"\s*(?:[-*+•·–—▪◦‣]\s|\(?\d{1,3}[.)]\s|\[[^\]]{1,12}\]|[a-z][.)]\s)")
_QUOTE = re.compile(r"\s*(?:>+\s|#+\s|[QA]:\s)")
_CODE = re.compile(r"[{}();=<>\[\]\\]|::|->|--")
_CODE_WORDS = frozenset("def fn let use return import class for if select insert create from where join const var public void assert assert_eq".split())
_GAPS = re.compile(r"\s{2,}")
_FIELDS = re.compile(r"[^\s|;,\t]+")
_HARSH = re.compile(r"[bcdfghjklmnpqrstvwxzß]{5,}|[aeiouy]{4,}")
_EASTERN = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_DAMAGE = re.compile(r"[ÃÂ][\u0080-ÿ€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ]|â€|â‚¬|[�←-⇿─-▟-\x00-\x08\x0e-\x1f]")
_NUMBER = re.compile(r"^[+\-]?[\d.,:/%x]*\d[\d.,:/%]*$")


def _bin(value: float, edges: tuple[float, ...]) -> int:
    return bisect_left(edges, value)


#: Number of bins of each statistic.
SIZES = (7, 5, 5, 6, 6, 6, 6, 6, 6, 5, 4, 5, 4, 5)


class _Kinds(dict):
    """Character -> s (white space), d (digit), a (letter), p (ordinary punctuation), y (symbol), filled as characters come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalnum() else "p" if c in ".,!?'’\"-“”。，、！？" else "y"
        self[code] = kind
        return kind


_KIND = _Kinds()


def observe(line: str) -> tuple[int, ...]:
    """The binned statistics of a line: common words, end, sentence ends, start, digits, symbols, words, columns, word length, repetition, damage, code marks, unpronounceable words, fields that are numbers."""
    return look(line)[0]


def look(line: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The binned statistics of a line, and its counts: characters that aren't white space, words, their characters, common words, symbols and punctuation, digits."""
    text = line.strip()
    n = len(text)
    lower = text.lower()
    words = _WORD.findall(lower if text.isascii() else lower.replace("’", "'"))
    kinds = text.translate(_KIND)
    n_digits, n_symbols, letters = kinds.count("d"), kinds.count("y"), sum(map(len, words))
    plain = text.isascii()
    east = 0 if plain else len(_EASTERN.findall(text))
    k, n_common = len(words), 0
    if east * 2 > letters or (east == 0 and k == 0):
        units = east / 2.0
        common = sum(c in _EAST for c in text) / max(1, east)
        common_bin = 1 if east == 0 else 1 + _bin(common, (0.0, 0.08, 0.16, 0.3))
        mean, distinct = 3, 4
        harsh = 0
        if east >= 40:
            pairs = [text[i : i + 2] for i in range(n - 1)]
            distinct = _bin(len(set(pairs)) / len(pairs), (0.2, 0.4, 0.6))
    else:
        units = float(k)
        hurt = 0 if plain or not _DAMAGE.search(text) else sum(bool(_DAMAGE.search(f)) for f in text.split())
        n_common = len([w for w in words if w in _COMMON])
        known = n_common * (1 - min(1.0, 2 * hurt / max(1, k)))
        if letters <= 1.5 * k:  # single letters are no words
            known = 0
        common_bin = 0 if not k else 1 + _bin(known / k, (0.0, 0.1, 0.2, 0.32, 0.45))
        mean = _bin(letters / k, (1.5, 3.0, 4.6, 6.0, 8.0)) if k else 5
        distinct = 4 if k < 8 else _bin(len(set(words)) / k, (0.25, 0.5, 0.7))
        long = len([w for w in words if len(w) > 3])
        harsh = _bin(min(1.0, len(_HARSH.findall(lower)) / long), (0.0, 0.15, 0.35)) if long else 0
    last = text[-1]
    end = 0 if last in ".!?。！？…\"”’»)" else 1 if last in ",;:，、；：" else 2 if last.isalpha() else 3 if last.isdigit() else 4
    stops = len(_STOP.findall(text))
    stop_bin = 0 if not stops else 1 + _bin(units / stops, (3.0, 7.0, 25.0))
    if _BULLET.match(text):
        start = 0
    elif _QUOTE.match(text):
        start = 1
    elif line[:2].isspace() and len(line) > 1:
        start = 2
    else:
        start = 3 if text[0].isupper() or _EASTERN.match(text) else 4 if text[0].isalpha() else 5
    digits = _bin(n_digits / n, (0.0, 0.04, 0.12, 0.25, 0.45))
    symbols = _bin(n_symbols / n, (0.0, 0.02, 0.06, 0.12, 0.25))
    words_bin = _bin(units, (0.0, 2.0, 4.0, 7.0, 14.0))
    columns = max(text.count("|"), text.count("\t"), text.count(";")) + (len(_GAPS.findall(text)) if "  " in text or "\t" in text else 0)
    commas = text.count(",")
    columns_bin = _bin(columns / max(1.0, units), (0.0, 0.08, 0.3)) if columns else 4 if commas and commas >= 0.5 * max(1.0, units) else 5 if commas else 0
    code = len(_CODE.findall(text)) if n_symbols or "--" in text or "->" in text else 0
    marks = _bin((code + len([w for w in words if w in _CODE_WORDS])) / max(1.0, units), (0.0, 0.06, 0.2, 0.5))
    damage = 0 if plain and text.isprintable() else _bin(len(_DAMAGE.findall(text)) / n, (0.0, 0.005, 0.03))
    fields = _FIELDS.findall(text)
    numeric = len([1 for f in fields if _NUMBER.match(f)]) if n_digits else 0
    numbers = _bin(numeric / len(fields), (0.0, 0.1, 0.3, 0.6)) if fields else 4
    bins = common_bin, end, stop_bin, start, digits, symbols, words_bin, columns_bin, mean, distinct, damage, marks, harsh, numbers
    return bins, (n - kinds.count("s"), k, letters, n_common, n_symbols + kinds.count("p"), n_digits)


def stretches(text: str) -> list[str]:
    """The lines of a text that aren't blank; lines over the limit in stretches, cut at white space where there is some."""
    out = []
    for line in _BREAKS.split(text):
        while len(line) > STRETCH * 3 // 2:
            cut = line.rfind(" ", STRETCH // 2, STRETCH)
            cut = cut + 1 if cut > 0 else STRETCH
            if line[:cut].strip():
                out.append(line[:cut])
            line = line[cut:]
        if line.strip():
            out.append(line)
    return out


_OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])

# Example lines that stand for the prior. A label has several states, as its lines come in kinds that have little in
# common; each paragraph here is one state.
_EXAMPLES = {
    "prose": """We looked at the report together, and it was not clear to us why the numbers had changed.
It works now.
He asked whether anyone had seen the letter, but nobody answered him.
and then the whole thing came to a halt because there was no room left on
THIS IS NOT WHAT WE WANTED, AND WE SAID SO WHEN THEY ASKED US.
Warum ist das so? Wir haben es gestern nicht bemerkt, aber heute war es für alle zu sehen.
Quand on le regarde de plus près, ce n'est pas la même chose et nous le savons.
No es lo que se espera, pero cuando lo leemos otra vez está bien para todos.
Não é por isso que o texto ficou assim, mas ninguém deu por nada até ao fim.
> I don't think that it was meant like this, and you may want to ask her about it.

为什么我们要在这里等他们？如果没有什么问题，那么就可以从头开始了。
我们从昨天开始就不再使用它，但是大家都没有发现。
なぜこの本はここにあるのだろうか。それを読むことができなかった。
昨日から、彼は何も言わないままだった。""",
    "list": """- red apples
* Blue paint, large brush and new ladder.
+ Old clock, wide table and green chair
• window — kitchen;
1. Open ports
[fix] broken lamp (#12)
* [Garden plan](/home/garden-3)
- kitchen table

chairs, tables, lamps, carpets
table, blue, kitchen, round, old
Small box, round lid
garden chair
kitchen table lamp
Chapter two ............ 14

- 苹果 香蕉
+ 红色的 苹果, 新的 桌子
[new] 窗户 桌子 (#31)
苹果, 香蕉, 桌子""",
    "table": """| name | size | 3.5 |
|---|---|---|
| apples | 70 | n/a |

apples 3 4.75 12
id,weight,price
7;0.5;n/a;12.25
north\t14\t2.5\tyes
total        12.0       88       0.4
1 220.5 17 9 0.25""",
    "code": """def area(width, height=None):
    return width * height
}
let total = items.len() as u64;
if (x == 0) { return y; }
use std::fmt::Display;
#[inline]
<div class="box"></div>

SELECT name, price FROM goods WHERE price < 10 ORDER BY 1;
CREATE TABLE goods (id bigint, name text);
INSERT INTO goods VALUES (1, 'box');""",
    "junk": """xqzt plkjh wrtzp qqsd fghjk lmnbv tzrwq
htrqp zzkeo aqqwl dfghe ptrwk

FÃ¼r die TÃ¼r ist es â€œzu spÃ¤tâ€, aber wir dÃ¼rfen nicht grÃ¶ÃŸer
Ã©tÃ© dÃ©jÃ  lÃ  oÃ¹ Ã§a a Ã©tÃ©
cafÃ©â€ Ã¼ber Ã¤hnlich

t h e s e l e t t e r s s t a n d a p a r t
I t i s a l l s p r e a d o u t

buy now buy now buy now buy now buy now buy now buy now buy now
garden garden garden garden garden garden garden garden garden

lamp garden blue table window old chair river small stone cloud box paper kitchen green ladder glass round hill

0000000 7f 3a 00 c4 91 be 08 2d
2024-01-01T00:00:00Z INFO [w1] took=12 code=0xff
  at app.main(main.rs:12)

aGVsbG8gd29ybGQhIHRoaXMgaXMgYmFzZTY0==
$%&*#@!!~~^^<<>>||
��▒▒╬┼�▒""",
}
_KINDS = [(name, kind.split("\n")) for name in STATES for kind in _EXAMPLES[name].split("\n\n")]
#: The label of each state of the model.
_LABEL = np.array([STATES.index(name) for name, _ in _KINDS])
_LABEL_OF = (_LABEL[:, None] == np.arange(len(STATES))).astype(float)
_ENDS = ".!?。！？…\"”’»"
_EXAMPLE_WEIGHT, _SMOOTH = 2.0, 0.4


def _start_model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(_KINDS)
    counts = np.zeros((n, sum(SIZES)))
    for s, (_, lines) in enumerate(_KINDS):
        for line in lines:
            counts[s, np.array(observe(line)) + _OFFSETS] += _EXAMPLE_WEIGHT
    same = _LABEL[:, None] == _LABEL[None, :]
    change = 0.3 + 1.0 * same + np.eye(n) * 20
    return counts, change, np.where(_LABEL == 0, 3.0, 1.0)


def _logs(counts: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    emit = np.empty_like(counts)
    for size, at in zip(SIZES, _OFFSETS, strict=True):
        part = counts[:, at : at + size] + _SMOOTH
        emit[:, at : at + size] = np.log(part / part.sum(1, keepdims=True))
    return emit, change / change.sum(1, keepdims=True), first / first.sum()


#: The statistics depend on each other; their joint weight of evidence is tempered by this factor.
_TEMPER = 0.7


def _groups(documents: list[np.ndarray]) -> Iterator[list[int]]:
    """Documents with lines, those of similar length together, as many as keep the padded lines within bounds (one, if it is longer)."""
    order = sorted((i for i in range(len(documents)) if len(documents[i])), key=lambda i: len(documents[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(documents[order[end]]) <= TOGETHER:
            end += 1
        yield order[at:end]
        at = end


def _recursion(seen: np.ndarray, lengths: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray], hints: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of each line by the forward-backward recursion, and with hints the expected transitions.

    It serves several documents of ascending lengths whose lines stand one after another; hints has a row per document.
    """
    emit, change, first = model
    doc = np.repeat(np.arange(len(lengths)), lengths)
    line = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    score = emit[:, seen + _OFFSETS].sum(2).T * _TEMPER
    if hints is not None:
        score = score + hints[doc]
    n = int(lengths[-1])
    padded = np.ones((n, len(lengths), len(first)))
    padded[line, doc] = np.exp(score - score.max(1, keepdims=True)) + 1e-12
    ahead, back = np.empty_like(padded), np.ones_like(padded)
    now = first * padded[0]
    ahead[0] = now / now.sum(1, keepdims=True)
    for i in range(1, n):
        now = (ahead[i - 1] @ change) * padded[i]
        ahead[i] = now / now.sum(1, keepdims=True)
    for i in range(n - 2, -1, -1):
        now = (back[i + 1] * padded[i + 1]) @ change.T
        now /= now.sum(1, keepdims=True)
        back[i] = np.where((i + 1 < lengths)[:, None], now, 1.0)
    gamma = (ahead * back)[line, doc]
    gamma /= gamma.sum(1, keepdims=True)
    moves = np.zeros(change.shape)
    if hints is not None and n > 1:
        go = np.arange(1, n)[:, None] < lengths[None, :]
        left, right = ahead[:-1][go], (padded[1:] * back[1:])[go]
        moves = change * ((left / ((left @ change) * right).sum(1, keepdims=True)).T @ right)
    return gamma, moves


def fit(judged: list[tuple[np.ndarray, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model after a few rounds of expectation-maximisation over judged documents (statistics of their lines, label)."""
    prior = _start_model()
    model = _logs(*prior)
    documents = [seen for seen, _ in judged]
    hint = np.array([np.where(_LABEL == STATES.index(label), 0.0, np.where(_LABEL == 0, -3.0, -5.0)) for _, label in judged]).reshape(-1, len(_LABEL))
    for k in range(ROUNDS if judged else 0):
        counts, change, first = (x.copy() for x in prior)
        by_value = counts.T.copy()
        for group in _groups(documents):
            seen, lengths = np.concatenate([documents[i] for i in group]), np.array([len(documents[i]) for i in group])
            gamma, moves = _recursion(seen, lengths, model, hint[group] * (3.0 if k == 0 else 1.0))
            for f, at in enumerate(_OFFSETS):
                np.add.at(by_value, seen[:, f] + at, gamma)
            change += moves
            first += gamma[np.cumsum(lengths) - lengths].sum(0)
        model = _logs(by_value.T.copy(), change, first)
    return model


def judged_sample(documents: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, str]]:
    """Statistics and labels of at most MAX_JUDGED judged documents, drawn by a hash of doc_id.

    Null and unknown labels are left out; of several labels of one document the first by name holds.
    """
    known = labels.where(F.lower(F.trim("label")).isin(*STATES) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(F.lower(F.trim("label"))).alias("label"))
    sample = drawn(known, F.xxhash64("doc_id"), MAX_JUDGED, known.count())
    rows = documents.select("doc_id", "text").where(F.length(F.trim("text")) > 0).join(F.broadcast(sample), "doc_id")  # at most MAX_JUDGED rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, label = [], []
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = stretches(text)
                if lines:
                    seen.append(np.array([observe(x) for x in lines], np.uint8).tobytes())
                    label.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(label, pa.string())], ["seen", "label"])

    found = rows.select("text", "label").mapInArrow(run, "seen binary, label string").collect()  # at most MAX_JUDGED rows
    found.sort(key=lambda r: (r.label, bytes(r.seen)))
    return [(np.frombuffer(bytes(r.seen), np.uint8).astype(np.int64).reshape(-1, len(SIZES)), r.label) for r in found]


_FIGURES = ["n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "n_lines", "ended_lines", "common_words", *(f"{s}_share" for s in STATES)]


def labels_of(documents: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The likeliest label of each line of each document; documents of similar length go through the recursion together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(documents)
    for group in _groups(documents):
        lengths = np.array([len(documents[i]) for i in group])
        gamma, _ = _recursion(np.concatenate([documents[i] for i in group]), lengths, model)
        for i, part in zip(group, np.split((gamma @ _LABEL_OF).argmax(1), np.cumsum(lengths)[:-1]), strict=True):
            out[i] = part
    return out


def figures(texts: list[str | None], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[float | None, ...]]:
    """The figures of each text, in the order of _FIGURES."""
    looks = [[look(x) for x in stretches(t)] if t else [] for t in texts]
    labels = labels_of([np.array([x[0] for x in own], np.int64).reshape(-1, len(SIZES)) for own in looks], model)
    out: list[tuple[float | None, ...]] = []
    for text, own, label in zip(texts, looks, labels, strict=True):
        if text is None:
            out.append((None,) * len(_FIGURES))
            continue
        if not own:
            out.append((len(text), 0, None, None, None, 0, None, None, *(None,) * len(STATES)))
            continue
        sums, shares = [0] * 6, [0] * len(STATES)
        for (_, counts), name in zip(own, label.tolist(), strict=True):
            shares[name] += counts[0]
            for i, x in enumerate(counts):
                sums[i] += x
        solid, words, letters, common, symbols, digits = sums
        whole = [x.rstrip() for x in _BREAKS.split(text) if x and not x.isspace()]
        out.append((
            len(text), words, letters / words if words else None, symbols / solid, digits / solid, len(whole), len([x for x in whole if x[-1] in _ENDS]) / len(whole),
            common / words if words else None, *(x / solid for x in shares),
        ))
    return out


def text_figures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id and its figures.

    n_chars, n_words, mean_word_length, symbol_ratio and digit_ratio (of the characters that aren't white space), n_lines (not blank),
    ended_lines (share that end in sentence punctuation), common_words (share), and the share of the characters that
    stand in lines labelled prose, list, table, code and junk. A null text has null figures, a blank one its length, no
    words and lines and null shares. Repeated rows are kept; other columns are ignored; without labels the
    prior's model is used.
    """
    model = fit(judged_sample(documents, labels))
    counted = {"n_chars", "n_words", "n_lines"}
    schema = f"`doc_id` {documents.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {'bigint' if c in counted else 'double'}" for c in _FIGURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = figures(part.column(1).to_pylist(), model)
                columns = [pa.array([r[i] for r in rows], pa.int64() if c in counted else pa.float64()) for i, c in enumerate(_FIGURES)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *_FIGURES])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def not_prose(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id): documents with a text that isn't blank, most of whose characters stand in lines that aren't prose."""
    return text_figures(documents, labels).where(F.col("prose_share") < 0.5).select("doc_id")
