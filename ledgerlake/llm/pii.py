"""Personal data: fixed patterns, and a linear-chain conditional random field.

Base. E-mail addresses, IPv4 addresses, card and phone numbers by pattern with
their checks (see ``base_spans``). The CRF labels words in BIO form from word-shape
features of a word and its neighbours, is trained on the small labelled table
``LABELLED`` (sentences with marked spans, filled by a seeded generator), and
is decoded by Viterbi over numpy batches. Its spans (the base kinds where a
check failed, and secrets such as keys or tokens) are added where they touch
no base span; of added cards only those of 13 to 19 digits that pass the Luhn check or stand
right after a word that names a card. The table also holds what is none: digests, commit
ids, UUIDs, book, order and account numbers. Of touching added spans each stays one.

A word without a digit, ``@``, ``=`` or ``+`` is plain. The CRF has structural
zeros: words further than ``REACH`` words from a word that isn't plain are
outside every span, so only the windows around such words are decoded, whole
and from every text.

Defined results: a null text is empty and holds nothing; spans are code point
offsets, end exclusive; repeated rows are searched row by row; an empty table
gives no rows; further columns pass through ``redact`` untouched."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, map_batches, read

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH, STEPS, LEARNING_RATE, RIDGE = 2, 120, 0.1, 1e-3
CELLS = 20_000
PLACES = "0-+<"

# The patterns of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a leftmost match starts its run of digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NAMES_CARD = re.compile(r"(?i)\b(?:card|visa|mastercard|amex)\b[^\w\n]*(?:(?:no|nr|number|num)\b[^\w\n]*)?$")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: the local part reaches back
    from its @ as far as its characters go, but not into the match before."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


def _digits(text: str, start: int, end: int) -> str:
    return "".join(c for c in text[start:end] if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if kind == "phone" and "+" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "ip":
                good = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
            else:
                d = _digits(text, *m.span())
                good = 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15
            if good:
                out.append((kind, *m.span()))
    return out


# ---- labelled table ----------------------------------------------------------

#: Sentences with marked spans; {w} is any word, the others are filled by kind.
LABELLED = (
    "{w} {w} [email] {w} {w}", "{w} {w}. [email] {w}", "mail: [email], {w} {w}", "{w} <[email]> {w}.", "[email]",
    "{w} {w} [ip] {w} {w}", "host [ip], {w}", "{w} {w} [ip]. {W} {w}", "[ip] {w} {w}", "{w} addr=[ip] {w}",
    "{w} {w} [card] {w} {w}", "card: [card], {w}", "{w} {w} [card]. {W} {w} {w}", "[card] {w} {w}", "{w} [card]",
    "{w} {w} [phone] {w} {w}", "tel [phone], {w}", "{w} {w} [phone]. {W} {w}", "[phone] {w} {w}", "call {w} [phone]",
    "{w} {w} token = \"[secret]\" {w} {w}", "{w} api_key = \"[secret]\" {w}", "password: [secret] {w}", "{w} secret=\"[secret]\" {w}",
    "token = \"[secret]\"", "{w} key = [secret] {w} {w}", "{w} {w} access_token: \"[secret]\", {w}",
    "{w} {w} {n} {w} {w}", "{w} {n}, {w} {w} {n}.", "version {v}. {w}", "{w} {w} {v} {w}", "in {y} {w} {w}", "{w} {n} = {n} {w}",
    "{w} {y}-{y} {w}", "{w} {w} = {w} {w}", "{w} {n}% {w} {w}", "{w}={w} {n}", "{w} {w} {w} {w} {w}", "{W} {n} {w} {w}.",
    "{w} @{w} {w}", "{w} {w} +{n} {w}", "{w} {n} {n} {n} {w}", "v{v} {w} {w}", "{w} CC BY-NC {v}.", "{w} a = b + c {w}",
    "License, Version {v}.", "Public License, version {n}.", "{w} {d} {w} {t} {w}", "{w} ${n}.{n} {w}", "({y}) {w} {w}",
    "password = [plainpass] {w}", "{w} password: \"[plainpass]\" {w}", "passwd=[plainpass] {w}", "{w} secret = '[plainpass]' {w}", "{w} [access] {w} {w}",
    "aws_access_key_id = [access]", "access key [access], {w}", "[access] {w}", "api key: [secret] {w}", "id = [access] {w}", "id [access], {w}", "{w}_token=[secret] {w}", "secret_key=[secret]", "{w} {w} token [secret] {w}",
    "commit {hex} {w} {w}", "{w} {w} {hex} {w} {w}", "{w} {hex}, {w}", "{hex} {w} {w}", "{w} {hex}", "md5 = {hex} {w}", "md5: {hex}", "sha256 = \"{hex}\" {w}",
    "{w} sha1 ({hex}) {w}", "checksum {hex} {w}", "id = {hex}", "rev=\"{hex}\", {w}", "{w} {uuid} {w} {w}", "uuid: {uuid}", "id = \"{uuid}\" {w}", "{uuid}, {w}",
    "isbn {isbn} {w}", "{w} ISBN: {isbn}, {w}", "order {long} {w} {w}", "{w} {w} {long} {w}", "{long}, {w} {w}", "no. {long} {w}", "iban {iban} {w}", "{w} {iban} {w}",
    "{w} token {n} {w}", "{w} key {n}, {w}", "the password of {n} {w} {w}", "key = {n}", "{w} secret {w} {y} {w}", "{w} part {part} {w}", "model {part}, {w}",
)


def labelled_sentences(rng: np.random.Generator, times: int = 12) -> list[tuple[list[str], list[int]]]:
    """Words and label numbers of the filled table."""
    def pick(chars: str, n: int) -> str:
        return "".join(rng.choice(list(chars), n))

    def word():
        return pick("abcdefghijklmnopqrstuvwxyzéüñ", rng.integers(1, 10)) + ["", "", "", "", ",", ".", "###", "!!", "%%%"][rng.integers(9)]

    digits, hexa = "0123456789", "0123456789abcdef"

    def unchecked(n):
        """Digits that fail the check of a card's."""
        d = pick(digits, n)
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)

    fill = {
        "w": word, "W": lambda: word().capitalize(), "n": lambda: pick(digits, rng.integers(1, 5)), "y": lambda: pick("12", 1) + pick(digits, 3),
        "v": lambda: f"{pick(digits, 1)}.{pick(digits, 1)}" + [f".{pick(digits, 1)}", ""][rng.integers(2)],
        "d": lambda: f"{pick('12', 1)}{pick(digits, 3)}-{pick('01', 1)}{pick(digits, 1)}-{pick('012', 1)}{pick(digits, 1)}",
        "t": lambda: f"{pick('01', 1)}{pick(digits, 1)}:{pick('012345', 1)}{pick(digits, 1)}",
        "email": lambda: f"{pick('abcdefghij', rng.integers(1, 8))}{['.', '_', ''][rng.integers(3)]}{pick(digits + 'xyz', rng.integers(1, 4))}@{pick('mailhost', 4)}{pick(digits, 1)}.{['com', 'example.com', 'org'][rng.integers(3)]}",
        "hex": lambda: pick(hexa, [32, 40, 64, 40][rng.integers(4)]), "uuid": lambda: "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)),
        "isbn": lambda: [pick(digits, 13), f"978-{pick(digits, 1)}-{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 1)}"][rng.integers(2)],
        "long": lambda: unchecked(rng.integers(9, 20)), "iban": lambda: pick("ABCDEFG", 2) + pick(digits, rng.integers(18, 23)),
        "part": lambda: pick("ABCXYZ", rng.integers(1, 4)) + ["-", ""][rng.integers(2)] + pick(digits, rng.integers(2, 6)),
        "plainpass": lambda: pick("abcdefghijklmnopqrstuvwxyz", rng.integers(3, 9)) + pick(digits, rng.integers(1, 4)) + ["", "", "!", "x"][rng.integers(4)],
        "access": lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 11) + pick("234567", 1) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 4),
        "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        "card": lambda: [pick(digits, 16), f"{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 4)}", " ".join(pick(digits, 4) for _ in range(4)), pick(digits, rng.integers(16, 20))][rng.integers(4)],
        "phone": lambda: [f"+{pick(digits, 1)} ({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", f"+{pick(digits, 2)} {pick(digits, 3)} {pick(digits, 4)} {pick(digits, 3)}", f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", f"+{pick(digits, 11)}"][rng.integers(4)],
        "secret": lambda: [pick(hexa, 40), pick(hexa, 32), pick(hexa.upper(), 40), pick(hexa, 64), pick(hexa + "ghijkXYZ_", 24)][rng.integers(5)],
    }
    out = []
    for template in LABELLED:
        for _ in range(times):
            text, marks, last = "", [], 0
            for m in re.finditer(r"\{(\w+)\}|\[(\w+)\]", template):
                text += template[last: m.start()]
                value, last = fill[m[1] or m[2]](), m.end()
                if m[2]:
                    marks.append(("secret" if m[2] in ("plainpass", "access") else m[2], len(text), len(text) + len(value)))
                text += value
            text += template[last:]
            ws, labels = [], []
            for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
                label = "O"
                for kind, s, e in marks:
                    if m.start() < e and m.end() > s:
                        label = ("B-" if m.start() <= s else "I-") + kind
                ws.append(m[0])
                labels.append(LABELS.index(label))
            out.append((ws, labels))
    return out


# ---- features ----------------------------------------------------------------

_EDGE = re.compile(r"^[\"'<(\[]*|[\"'>)\].,;:!?#$%&*|]*$")


def shape(w: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: "9" * min(3, len(m[0])), w)
    return re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", s)[:24]


def plain(w: bytes) -> bool:
    return not re.search(rb"[0-9@=+]", w)


def word_features(w: str) -> list[str]:
    """Shape features of one word."""
    core = _EDGE.sub("", w) or w
    digits = sum("0" <= c <= "9" for c in core)
    out = [f"shape={shape(core)}", f"digits={digits if digits < 5 else '5-10' if digits < 11 else '11-15' if digits < 16 else '16-19' if digits < 20 else '20+'}",
           f"length={min(8, len(core).bit_length())}", f"only={bool(re.fullmatch('[0-9]+', core))}",
           f"hex={len(core) >= 24 and bool(re.fullmatch('[0-9a-fA-F]+', core))}", f"long={len(core) >= 20 and digits > 3}",
           f"quoted={w[:1] in chr(34) + chr(39)}", f"at={'@' in core and '.' in core.rsplit('@', 1)[-1]}",
           f"dots={core.count('.') if core.count('.') < 4 else 4}", f"plus={w[:1] == '+'}", f"bracket={w[:1] == '('}", f"dash={'-' in core}"]
    low = core.lower()
    if any(k in low for k in ("token", "key", "secret", "passw")):
        out.append("names a secret")
    if any(k in low for k in ("commit", "md5", "sha1", "sha256", "uuid", "checksum", "digest", "etag", "isbn", "iban", "order")) or low in ("id", "rev", "hash", "no"):
        out.append("names a number")
    if re.fullmatch("[A-Z0-9]{16,24}", core) and not core.isdigit():
        out.append(f"capital key={core[:4]}")
    if w in ("=", ":", ":=") or w[-1:] in "=:":
        out.append("assigns")
    return out


class Features:
    """Numbers of a word's features at four places: itself, before, after, two before."""

    def __init__(self, known: dict[str, int]):
        self.known = known

    def __call__(self, w: bytes) -> tuple[np.ndarray, ...]:
        names = word_features(w.decode("utf-8"))
        return tuple(np.array([self.known[k] for f in names if (k := f"{p}{f}") in self.known], np.int64) for p in PLACES)


class Crf:
    """Weights: emission (features x labels), transition and start (labels)."""

    def __init__(self, known: dict[str, int], emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.known, self.emission, self.transition, self.start = known, emission, transition, start

    def word_scores(self) -> Cache:
        """word -> scores it adds to its own place, the next, the one before and the next but one."""
        features = Features(self.known)
        return Cache(lambda w: tuple(self.emission[f].sum(axis=0) for f in features(w)), 50_000)

    def scores(self, sequences: list[list[bytes]], cache: Cache) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place, label) scores, padded, and lengths."""
        n = np.array([len(s) for s in sequences])
        out = np.zeros((len(n), n.max(), len(LABELS)))
        for i, s in enumerate(sequences):
            got = [cache[w] for w in s]
            out[i, : len(s)] = [g[0] for g in got]
            out[i, 1: len(s)] += [g[1] for g in got[:-1]] if len(s) > 1 else 0
            out[i, : len(s) - 1] += [g[2] for g in got[1:]] if len(s) > 1 else 0
            out[i, 2: len(s)] += [g[3] for g in got[:-2]] if len(s) > 2 else 0
        return out, n

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of every sequence of a batch."""
        n, steps, _ = scores.shape
        best, back = scores[:, 0] + self.start, np.zeros(scores.shape, np.int64)
        for t in range(1, steps):
            total = best[:, :, None] + self.transition
            back[:, t] = total.argmax(axis=1)
            new = total.max(axis=1) + scores[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        out, rows = np.zeros((n, steps), np.int64), np.arange(n)
        label = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            inside = t < lengths
            out[inside, t] = label[inside]
            label = np.where(inside, back[rows, t, label], label)
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[int]]], steps: int = STEPS) -> Crf:
    """Maximum likelihood by forward-backward and Adam, on the driver: the table is small."""
    known: dict[str, int] = {}
    for ws, _ in table:
        for w in ws:
            for f in word_features(w):
                for p in PLACES:
                    known.setdefault(f"{p}{f}", len(known))
    k, features = len(LABELS), Features(known)
    n, longest = len(table), max(len(ws) for ws, _ in table)
    lengths, gold = np.array([len(ws) for ws, _ in table]), np.zeros((n, longest), np.int64)
    at, feature = [], []  # place of every active feature in the flattened batch
    for i, (ws, labels) in enumerate(table):
        gold[i, : len(ws)] = labels
        got = [features(w.encode()) for w in ws]
        for t in range(len(ws)):
            none = got[t][0][:0]
            for f in (got[t][0], got[t - 1][1] if t else none, got[t + 1][2] if t + 1 < len(ws) else none, got[t - 2][3] if t > 1 else none):
                at.append(np.full(len(f), i * longest + t))
                feature.append(f)
    at, feature = np.concatenate(at), np.concatenate(feature)
    mask = np.arange(longest) < lengths[:, None]
    weights = [np.zeros((len(known), k)), np.zeros((k, k)), np.zeros(k)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    hot = np.eye(k)[gold] * mask[:, :, None]
    pairs = mask[:, 1:, None, None] * hot[:, :-1, :, None] * hot[:, 1:, None, :]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        emission, transition, start = weights
        scores = np.zeros((n * longest, k))
        np.add.at(scores, at, emission[feature])
        scores = scores.reshape(n, longest, k)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0] + start
        for t in range(1, longest):
            new = _log_sum(alpha[:, t - 1, :, None] + transition, 1) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(transition + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t + 1])
        z = _log_sum(alpha[rows, lengths - 1], 1)
        single = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        double = np.exp(alpha[:, :-1, :, None] + transition + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        g0 = np.zeros_like(emission)
        np.add.at(g0, feature, (single - hot).reshape(n * longest, k)[at])
        grads = [g0 / n + RIDGE * emission, (double - pairs).sum(axis=(0, 1)) / n + RIDGE * transition, (single - hot)[:, 0].sum(axis=0) / n + RIDGE * start]
        for w, g, m in zip(weights, grads, moments):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            w -= LEARNING_RATE * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
    return Crf(known, *weights)


_MODEL: list[Crf] = []


def model() -> Crf:
    """The CRF trained on the labelled table, once per driver process."""
    if not _MODEL:
        _MODEL.append(train(labelled_sentences(np.random.default_rng(4))))
    return _MODEL[0]


# ---- search --------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@=+]")


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) within REACH words of a word that isn't plain."""
    out: list[list[tuple[int, int]]] = []
    pos = 0
    while mark := _MARK.search(text, pos):
        start = mark.start()
        while start and not text[start - 1] in " \t\n\v\f\r":
            start -= 1
        before, at = [], start  # up to REACH words before
        while at and len(before) < REACH:
            end = at
            while end and text[end - 1] in " \t\n\v\f\r":
                end -= 1
            at = end
            while at and text[at - 1] not in " \t\n\v\f\r":
                at -= 1
            if at < end:
                before.append((at, end))
        if out and before and before[-1][0] <= out[-1][-1][1] or out and start <= out[-1][-1][1]:
            run = out[-1]
            run.extend(w for w in reversed(before) if w[0] > run[-1][0])
        else:
            run = list(reversed(before))
            out.append(run)
        left = 0  # words after the last word that isn't plain
        for m in _WORD.finditer(text, start):
            left = left + 1 if plain(m[0].encode()) else 0
            if not run or m.start() > run[-1][0]:
                run.append(m.span())
            pos = m.end()
            if left >= REACH:
                break
        else:
            break
    return out


def crf_spans(texts: list[str], crf: Crf, cache: Cache) -> list[list[tuple[str, int, int]]]:
    """Spans the CRF finds in each text; words' marks at either end don't belong."""
    where = [(i, run) for i, t in enumerate(texts) for run in windows(t)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    where.sort(key=lambda x: len(x[1]))
    at = 0
    while at < len(where):
        n = 1  # windows of like length, about CELLS padded words together
        while at + n < len(where) and (n + 1) * len(where[at + n][1]) <= CELLS:
            n += 1
        part, at = where[at: at + n], at + n
        scores, lengths = crf.scores([[texts[i][s:e].encode() for s, e in run] for i, run in part], cache)
        for (i, run), labels in zip(part, crf.viterbi(scores, lengths)):
            j = 0
            while j < len(run):
                label = LABELS[labels[j]]
                if label == "O":
                    j += 1
                    continue
                kind, first = label[2:], j
                j += 1
                while j < len(run) and LABELS[labels[j]] == f"I-{kind}":
                    j += 1
                start, end = run[first][0], run[j - 1][1]
                core = _trim(texts[i], start, end, kind)
                if core:
                    out[i].append((kind, *core))
    return out


def _trim(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    if kind in ("secret", "ip") and "=" in text[start:end].rstrip("="):
        start = text.rindex("=", start, len(text[:end].rstrip("="))) + 1
    while start < end and text[start] in "\"'<[" + ("" if kind == "phone" else "("):
        start += 1
    while start < end and text[end - 1] in "\"'>)].,;:!?#$%&*|":
        end -= 1
    return (start, end) if start < end and any("0" <= c <= "9" or c == "@" for c in text[start:end]) else None


def all_spans(texts: list[str], crf: Crf, cache: Cache) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; both by kind as listed, then start."""
    out = []
    for text, extra in zip(texts, crf_spans(texts, crf, cache)):
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        added = [x for x in extra if not any(s < x[2] and x[1] < e for s, e in taken) and (x[0] != "card" or _card(text, *x[1:]))]
        out.append((base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def _card(text: str, start: int, end: int) -> bool:
    """Whether an added card span has a card's digits, and passes the check or stands right after a word that names a card."""
    d = _digits(text, start, end)
    return 13 <= len(d) <= 19 and (luhn(d) or bool(_NAMES_CARD.search(text, max(0, start - 32), start)))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]),
                      T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def op4_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    crf = model()

    def make():
        cache = crf.word_scores()

        def run(batch):
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], crf, cache)
            counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS[:4]]
            return [batch.column("doc_id"), *counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], [joined(a) for _, a in found]]
        return run

    return map_batches(docs, make, T.StructType([T.StructField("doc_id", T.LongType()), *FOUND]))


def redact(docs: DataFrame) -> DataFrame:
    """Every span becomes its kind in angle brackets; n_chars, if there, follows."""
    crf, rows = model(), docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("clean", T.StringType())])

    def make():
        cache = crf.word_scores()

        def run(batch):
            held = batch.column("text").to_pylist()
            clean = []
            for text, (_, spans) in zip(held, all_spans([t or "" for t in held], crf, cache)):
                clean.append(None if text is None else _replaced(text, spans))
            return [batch.column("row"), clean]
        return run

    out = map_batches(rows, make, schema)
    kinds = dict(docs.dtypes)
    new = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return out.select(*((new[c].cast(kinds[c]) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def _replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"<{kind}>"]
        last = max(last, e)
    return "".join(out) + text[last:]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with its spans as ``<kind>`` and n_chars after that; null and empty
    texts as they are, repeated rows row by row."""
    return redact(docs)
