"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field labels words: outside, or one of ``KINDS``. A word speaks for a label through its
features (its shape, the lengths of its runs of digits, whether a checksum holds, the word
itself if it is a cue), for its own place and for those before and after it. It is trained on a small
labelled table by its likelihood, and decoded by Viterbi in numpy for whole batches of texts.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns' parts in the order in which kinds are listed, and their limits.
BASE = ["email", "ip", "card", "phone"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # takes every run of digits, so none is looked at twice
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

#: What the field labels, in the order in which spans list them after the base kinds.
KINDS = ["crf_email", "crf_phone", "crf_ip", "crf_card", "crf_id", "crf_name"]
LABELS = len(KINDS) + 1
SURE = 1e3  # leads by more than any transitions can make up
DIGIT = re.compile("[0-9]")
EDGES = ".,;:!?\"'*#%$<>[]{}"  # never part of an added span's ends


TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Mme", "M.", "Mlle", "Señor", "Señora", "Sr.", "Sra.", "Prof."]
CALLS = ["tel.", "tel:", "phone", "phone:", "call", "Telefon", "Tel.", "téléphone", "mobile", "fax", "teléfono"]
MARKS = [("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}")]
SIGNS = ["mail", "e-mail:", "write", "host", "IP", "from", "card", "Visa", "Karte", "SSN", "SSN:", "IBAN", "IBAN:"]
#: The words that are features by themselves; of others only the form counts.
CUES = {w.lower().strip(".:") for w in [*TITLES, *CALLS, *SIGNS, *(m for both in MARKS for m in both)]}


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: what may stand before it back to the last match, and a domain. One look at each character, however long a word is."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        local = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts of each dotted run of digits at a time, as a search from the left takes them."""
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the base matches, sorted."""
    found = [(0, s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        found += [(1, s, e) for s, e in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= CARD_DIGITS[0] and CARD_DIGITS[0] <= len(d := digits_of(m.group())) <= CARD_DIGITS[1] and luhn(d):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(digits_of(m.group())) <= PHONE_DIGITS[1]]
    return sorted(found)


def shape(word: str) -> str:
    """The word's kinds of characters, repeats once: x, X and 9 for letters and digits, other marks as they are."""
    return "".join(c for c, _ in groupby("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:64]))[:24]


def features(word: str) -> tuple[str, ...]:
    core = word.strip(EDGES + "()")
    out = ["shape " + shape(word), "cue " + cue] if (cue := word.strip(".,;:!?\"'*#%$&").lower()) in CUES else ["shape " + shape(word)]
    if runs := re.findall("[0-9]+", word[:128]):
        n = sum(map(len, runs))
        out += ["runs " + " ".join(str(min(len(r), 20)) for r in runs[:8]), f"digits {min(n, 20)}", f"few {len(runs)} {len(core) - n}"]
        if CARD_DIGITS[0] <= n <= CARD_DIGITS[1]:
            out.append(f"sum {luhn(''.join(runs))}")
        out.append("hex" if ":" in core and re.fullmatch("[0-9a-fA-F:]+", core) else "mixed" if re.search("[A-Za-z]", core) else "plain")
    out.append("marks " + "".join(sorted({c for c in word[:64] if not c.isalnum()})))
    return tuple(out)


@dataclass
class Model:
    """Weights of features x (before, own, after) x labels, of transitions, and the features' rows."""

    rows: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def emission(self, word: str) -> np.ndarray:
        """What a word says for the place before it, its own and the place after it; a feature that no labelled word has says nothing."""
        known = [i for f in features(word) if (i := self.rows.get(f)) is not None]
        return self.weights[known].sum(axis=0)


def sequences(rows: list[tuple[list[str], list[int]]], least: int) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features that ``least`` words have, their (place, feature), and labels and places padded to one length."""
    told = [[features(w) for w in words] for words, _ in rows]
    seen = Counter(f for words in told for fs in words for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    long = max((len(w) for w, _ in rows), default=1)
    labels, there = np.zeros((len(rows), long), np.int64), np.zeros((len(rows), long), bool)
    place, feature = [], []
    for i, (words, (_, own)) in enumerate(zip(told, rows, strict=True)):
        labels[i, : len(own)], there[i, : len(own)] = own, True
        for t, fs in enumerate(words):
            for f in fs:
                if f in index:
                    place.append(i * long + t)
                    feature.append(index[f])
    return index, np.array(place, np.int64), np.array(feature, np.int64), labels, there


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_words(rows: list[tuple[list[str], list[int]]], least: int = 3, penalty: float = 0.02, steps: int = 110, rate: float = 0.2) -> Model:
    """Maximises the labels' likelihood less ``penalty`` of the squared weights, by Adam over all rows at each step (forward and backward sums over all rows at once)."""
    index, place, feature, labels, there = sequences(rows, least)
    n, long = labels.shape
    size, pads = len(index), [(-1, 0), (0, 1), (1, 2)]
    theta = np.zeros(size * 3 * LABELS + LABELS * LABELS)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inside = there[:, 1:]
    one = np.eye(LABELS)[labels] * there[..., None]

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by < 0:
            out[:, :by] = x[:, -by:]
        elif by > 0:
            out[:, by:] = x[:, :-by]
        else:
            out[:] = x
        return out

    for step in range(1, steps + 1):
        weights, moves = theta[: size * 3 * LABELS].reshape(size, 3, LABELS), theta[size * 3 * LABELS :].reshape(LABELS, LABELS)
        own = np.zeros((n * long, 3, LABELS))
        for k in range(3):
            for y in range(LABELS):
                own[:, k, y] = np.bincount(place, weights[feature, k, y], n * long)
        own = own.reshape(n, long, 3, LABELS)
        emit = sum(moved(own[:, :, k], by) for by, k in pads)
        ahead, back = np.zeros((n, long, LABELS)), np.zeros((n, long, LABELS))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, long):
            ahead[:, t] = np.where(inside[:, t - 1, None], emit[:, t] + log_sum(ahead[:, t - 1, :, None] + moves, 1), ahead[:, t - 1])
        for t in range(long - 2, -1, -1):
            back[:, t] = np.where(inside[:, t, None], log_sum(moves + (emit[:, t + 1] + back[:, t + 1])[:, None], 2), 0)
        total = log_sum(ahead[:, -1], 1)
        share = np.exp(ahead + back - total[:, None, None]) * there[..., None]
        both = np.exp(ahead[:, :-1, :, None] + moves + (emit + back)[:, 1:, None, :] - total[:, None, None, None]) * inside[..., None, None]
        wrong = share - one
        gradient = np.empty_like(theta)
        slopes = gradient[: size * 3 * LABELS].reshape(size, 3, LABELS)
        for by, k in pads:
            x = moved(wrong, -by).reshape(-1, LABELS)
            for y in range(LABELS):
                slopes[:, k, y] = np.bincount(feature, x[place, y], size)
        gradient[size * 3 * LABELS :] = (both.sum(axis=(0, 1)) - np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])).ravel()
        gradient += penalty * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(index, theta[: size * 3 * LABELS].reshape(size, 3, LABELS).astype(np.float32), theta[size * 3 * LABELS :].reshape(LABELS, LABELS).astype(np.float32))


def viterbi(emit: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The likeliest labels of the sequences that begin at ``starts`` and fill ``emit``, all at once: one step for each place of the longest."""
    sizes = np.diff(np.r_[starts, len(emit)])
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = starts[order], sizes[order]
    came = np.zeros((len(emit), LABELS), np.int8)
    score = emit.copy()
    for t in range(1, int(sizes.max(initial=0))):
        at = begin[: np.searchsorted(-sizes, -t)] + t  # the sequences that are longer than t
        to = score[at - 1][:, :, None] + moves
        came[at] = to.argmax(axis=1)
        score[at] = emit[at] + np.take_along_axis(to, came[at][:, None].astype(np.int64), 1)[:, 0]
    labels = np.zeros(len(emit), np.int64)
    ends = begin + sizes - 1
    labels[ends] = score[ends].argmax(axis=1)
    for t in range(1, int(sizes.max(initial=0))):
        at = ends[: np.searchsorted(-sizes, -t)] - t
        labels[at] = came[at + 1, labels[at + 1]]
    return labels


def label_texts(texts: list[str], model: Model, known: dict[str, int], table: list[np.ndarray], alike: dict[bytes, int]) -> list[np.ndarray]:
    """The labels of each text's words (as ``str.split`` gives them).

    A word for which "outside" leads by more than any two transitions can make up is outside
    on every likeliest path, so sequences are decoded between such words only.
    """
    parts = []
    for text in texts:
        words = text.split()
        for w in set(words).difference(known):
            e = model.emission(w)
            known[w] = alike.setdefault(e.tobytes(), len(table))
            if known[w] == len(table):
                table.append(e)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))  # what stands between two texts says nothing
    flat = np.concatenate(parts)
    says = np.stack(table)
    emit = says[flat, 1]
    emit[1:] += says[flat[:-1], 2]
    emit[:-1] += says[flat[1:], 0]
    emit[flat == 0] = 0
    emit[flat == 0, 0] = SURE
    sure = emit[:, 0] - emit[:, 1:].max(axis=1) > 2 * (model.moves.max() - model.moves.min())
    labels = np.zeros(len(flat), np.int64)
    open_ = np.flatnonzero(~sure)
    if len(open_):
        # each run of open words with the sure ones beside it, which can only be outside
        run = np.r_[True, np.diff(open_) > 1]
        starts, ends = open_[run], np.r_[open_[:-1][run[1:]], open_[-1]]
        edge = np.zeros((1, LABELS), np.float32)
        edge[0, 0] = SURE
        sizes = ends - starts + 1
        at = np.r_[0, np.cumsum(sizes + 2)]
        padded = np.repeat(edge, at[-1], axis=0)
        inner = np.arange(at[-1])
        inner = inner[np.isin(inner, np.r_[at[:-1], at[1:] - 1], invert=True)]
        padded[inner] = emit[open_]
        labels[open_] = viterbi(padded, model.moves, at[:-1])[inner]
    sizes = np.fromiter((len(x) for x in parts[::2]), np.int64, len(texts))
    return np.split(labels, np.cumsum(sizes + 1)[:-1])


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of words of one label, without marks at their ends, unless they touch a base span."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    taken = sorted((s, e) for _, s, e in base)
    out, at = [], 0
    for label, run in groupby(labels[: len(words)].tolist()):
        n = len(list(run))
        if label:
            s, e = words[at][0], words[at + n - 1][1]
            core = text[s:e]
            s, e = s + len(core) - len(core.lstrip(EDGES)), e - len(core) + len(core.rstrip(EDGES))
            if s < e and not any(x < e and s < y for x, y in taken):
                out.append((len(BASE) + label - 1, s, e))
        at += n
    return out


# The labelled table.

def made_item(rng: random.Random) -> tuple[list[str], list[int]]:
    """One piece of personal data in a spelling that the base patterns miss, and its words' labels."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: rng.choice("ABCDEFGHJKLMNPRSTVW") + "".join(rng.choice("aeiou") + rng.choice("bdklmnrst") for _ in range(rng.randint(1, 3)))
    low = lambda: name().lower()
    kind = rng.choice(KINDS)
    cue: list[str] = []
    if kind == "crf_email":
        at, dot = rng.choice(MARKS)
        item = rng.choice([[low(), at, low(), dot, rng.choice(["com", "org", "net", "de", "fr"])], [f"{low()}{at}{low()}{dot}com"], [f"{low()}.{low()}", at, f"{low()}.{rng.choice(['com', 'org'])}"]])
        cue = rng.choice([[], ["mail"], ["e-mail:"], ["write", "to"]])
    elif kind == "crf_phone":
        item = rng.choice([[f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"0{digits(3)}/{digits(7)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"], [f"00{digits(2)}", digits(3), digits(7)], [f"0{digits(1)}", digits(2), digits(2), digits(2), digits(2)]])
        cue = rng.choice([[], [rng.choice(CALLS)], [rng.choice(CALLS)]])
    elif kind == "crf_ip":
        part = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4)))
        item = [rng.choice([":".join(part() for _ in range(8)), f"{part()}:{part()}::{part()}", f"fe80::{part()}:{part()}", ".".join(str(rng.randint(0, 255)) for _ in range(3)) + "[.]" + str(rng.randint(0, 255))])]
        cue = rng.choice([[], ["host"], ["IP"], ["from"]])
    elif kind == "crf_card":
        item = ["".join((x := digits(15), str(next(d for d in range(10) if luhn(x + str(d))))))]
        item = rng.choice([[".".join(re.findall("....", item[0]))], ["/".join(re.findall("....", item[0]))], ["_".join(re.findall("....", item[0]))]])
        cue = rng.choice([[], ["card"], ["Visa"], ["Karte"]])
    elif kind == "crf_id":
        item = rng.choice([[f"{digits(3)}-{digits(2)}-{digits(4)}"], [rng.choice(["DE", "FR", "ES", "GB"]) + digits(2), *[digits(4) for _ in range(4)], digits(2)], [rng.choice(["DE", "FR", "ES"]) + digits(20)]])
        cue = rng.choice([[], ["SSN"], ["SSN:"], ["IBAN"], ["IBAN:"]])
    else:
        item = rng.choice([[name(), name()], [name()]])
        cue = [rng.choice(TITLES)]
    end = rng.choice(["", "", "", ".", ",", ";", "!!"])
    item[-1] += end
    return cue + item, [0] * len(cue) + [KINDS.index(kind) + 1] * len(item)


def plain_item(rng: random.Random) -> list[str]:
    """Words that look like personal data and are none: keys, versions, dates, sums, lists, runs of capitals, card numbers that don't hold."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice(["L", "P", "A", "É", "G", "Th", "En", "O"]) + "".join(rng.choice("aeiou") + rng.choice("bdklmnrst") for _ in range(rng.randint(1, 4)))
    key = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40])))
    number = next(n for n in iter(lambda: digits(16), "") if not luhn(n))
    date = rng.choice([f"20{digits(2)}-0{rng.randint(1, 9)}-{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}"])
    items = [["token", "=", f'"{key}"'], [key], [key.upper()], ["version", f"{digits(1)}.{digits(1)}"], [date], [f"{digits(2)}.{digits(2)}"], [f"{digits(1)}."], [f"{digits(3)},{digits(3)}"], [f"{digits(2)}:{digits(2)}"], [number], [" ".join(re.findall("....", number))], ["A.", word()], [word() + rng.choice(["", ".", ",", "&&&"])] * rng.randint(2, 12), [word() + rng.choice(["", "", ".", "%%%"]) for _ in range(rng.randint(2, 8))], [rng.choice(["At", "at", "to", "en"])] * rng.randint(1, 6), [word() + ".", word()], [word() + ",", word()], [f"{word()}/{word().lower()}"], [f"({word().lower()})"], [f"[{digits(1)}]"]]
    return " ".join(rng.choice(items)).split()


def labelled(docs: DataFrame, rows: int = 600, words: int = 24, seed: int = 7) -> DataFrame:
    """(words, labels): a small labelled table of ``rows`` runs of ``words`` words.

    The runs are cut from texts chosen by a hash; the rule-made items above, personal or
    plain, are set into them at random places, up to four to a run. All other words count as outside, those of the
    base patterns too, as their spans are found already.
    """
    own = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    chosen = own.select("h").distinct().orderBy("h").limit(rows)  # only hashes are shuffled
    at = F.pmod("h", F.greatest(F.size("w") - words, F.lit(0)) + 1)
    cut = own.join(F.broadcast(chosen), "h").withColumn("w", F.split("text", r"\s+")).select("h", F.slice("w", at.cast("int") + 1, words).alias("w")).dropDuplicates(["h"])
    rng, out = random.Random(seed), []
    for i, r in enumerate(cut.orderBy("w").collect()):  # bounded: ``rows`` runs
        told = [w for w in r["w"] if w and not w.isspace()]
        labels = [0] * len(told)
        for _ in range(4):
            item, own = made_item(rng) if rng.random() < 0.4 else (plain_item(rng), [])
            own = own or [0] * len(item)
            spot = rng.randint(0, len(told))
            if not (spot and labels[spot - 1]) and not (spot < len(labels) and labels[spot]):
                told[spot:spot], labels[spot:spot] = item, own
        out.append((told, labels))
    return docs.sparkSession.createDataFrame(out, "words array<string>, labels array<int>")


def fit(table: DataFrame) -> Model:
    """The model of a small labelled table (words, labels), which is collected; without rows it labels nothing. Null and empty rows are skipped."""
    rows = [(r["words"], r["labels"]) for r in table.collect() if r["words"]]
    if not rows:
        return Model({}, np.zeros((0, 3, LABELS), np.float32), np.r_[[[1.0] + [0.0] * (LABELS - 1)] * LABELS].astype(np.float32))
    return fit_words(sorted(rows))


def told(spans: list[tuple[int, int, int]]) -> str:
    names = BASE + KINDS
    return ",".join(f"{names[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal(docs: DataFrame, model: Model, keep_words: int = 500_000) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_crf, base_sha256, spans) for every whole text.

    Offsets are code points, end exclusive. Base spans are told by kind, then start, and so
    are the added ones after them, which never touch a base span. A null text counts as
    empty. Repeated rows each give their row; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: ({}, [np.zeros((3, LABELS), np.float32)], {})
        state = fresh()
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            if len(state[0]) > keep_words:
                state = fresh()
            base = [base_spans(t) for t in texts]
            more = [added_spans(t, y, own) if y.any() else [] for t, y, own in zip(texts, label_texts(texts, model, *state), base, strict=True)] if texts else []
            kinds = [pa.array([sum(x[0] == k for x in own) for own in base], pa.int64()) for k in range(len(BASE))]
            digests = pa.array([hashlib.sha256(told(x).encode()).hexdigest() for x in base], pa.string())
            both = pa.array([told(x + y) for x, y in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *kinds, pa.array(map(len, more), pa.int64()), digests, both], ["doc_id", *[f"n_{k}" for k in BASE], "n_crf", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_crf long, base_sha256 string, spans string")
