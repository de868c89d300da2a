"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags,
with the path of open elements. Each block is read as the sum of learned
vectors of its path's hashed marks (tag names and the words of class, id and
role) over the root of their count, the mean of learned vectors of its hashed words, and a few shares. A
bidirectional LSTM in numpy runs over the whole page, and every block is
labelled article or not from what stands before and after it. Article blocks
are joined in page order.

The labeller is trained on the driver from ``TRAIN_PAGES`` generated pages whose
labels are known by construction (``sample_page``): many layouts with and without
semantic tags, invented words, prose and lists on both sides. No row of the
tables is read for training. The weights are under 1 MB and travel in the task.

Defined results: a null or empty page, or one without a block labelled article,
has an empty text; character references are decoded, white space within a block
becomes one space; scripts, styles, templates and comments of the markup hold no
blocks; a tag that isn't closed ends with its parent, a page cut anywhere ends
there; repeated rows give equal rows; pages and blocks of any length are read
whole; a score of exactly 0.5 is article; an empty table gives no rows."""

from __future__ import annotations

import copy
import functools
import html as entities
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, map_batches, read

TRAIN_PAGES, EPOCHS, HIDDEN = 2000, 6, 16
RARE = 1e-4  # gradients of words below this size hardly move them
PATHS, WORDS, PATH_DIM, WORD_DIM, SHARES = 8192, 4096, 20, 10, 8
DIM = PATH_DIM + WORD_DIM + SHARES

# ---- page -> leaf blocks --------------------------------------------------------

SKIPPED = "script|style|template|noscript|svg|math|iframe|object|canvas|audio|video|textarea|select|head"
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{SKIPPED})\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>{_ATTRIBUTES})>|<[!?/][^>]*(?:>|\Z)|<(?P<broken>[a-z][^\s/>]*)[^>]*(?:>|\Z)",
    re.I | re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open element of these names (up to a list or table).
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table".split())


def _hash(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def _marks(key: tuple[str, str]) -> tuple[int, ...]:
    """Hashed marks of an element: its name, the words of class, id and role, and
    the five-letter pieces of long ones."""
    name, attributes = key
    words = {"<" + name}
    for value in _MARKS.findall(attributes):
        for w in _PART.findall(value):
            w = w.lower()
            words.add(w)
            if len(w) > 7:  # names run together
                words.update("~" + w[i:i + 5] for i in range(len(w) - 4))
    return tuple(sorted({_hash(w, PATHS) for w in words}))


_ELEMENTS = Cache(_marks, 50_000)
_WORDS = Cache(lambda w: _hash(w.lower(), WORDS), 200_000)


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: list[int], linked: float):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks with a word, in page order."""
    out: list[Block] = []
    names: list[str] = []
    marks: list[tuple[int, ...]] = []
    parts: list[str] = []
    path: list[int] = []
    linked = links = 0

    def here() -> list[int]:
        return [*(x for e in marks for x in e), _hash(">" + names[-1] if names else ">", PATHS)]

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, path, min(1.0, linked / max(1, len(text)))))
        parts.clear()
        linked = 0

    def drop(at: int):
        nonlocal links
        links -= names[at:].count("a")
        del names[at:], marks[at:]

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            if not parts or not path:
                if not piece.isspace():
                    path = here()
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = (m["name"] or m["broken"] or "").lower()
        if not name:
            if m["raw"]:
                flush()
                path = []
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            path = []
        if m["end"]:
            if name in names:
                drop(len(names) - 1 - names[::-1].index(name))
            continue
        if name not in INLINE and "p" in names:  # a block ends an open paragraph
            drop(len(names) - 1 - names[::-1].index("p"))
        for i in range(len(names) - 1, -1, -1):
            if names[i] in SCOPES or name not in ENDS:
                break
            if names[i] in ENDS[name]:
                drop(i)
                break
        attributes = m["attributes"] or ""
        if name in VOID or attributes.endswith("/"):
            continue
        names.append(name)
        marks.append(_ELEMENTS[name, attributes if name != "a" and ("=" in attributes) else ""])
        links += name == "a"
    if at < len(page):
        path = path or here()
        parts.append(page[at:])
        if links:
            linked += len(page) - at
    flush()
    return out


# ---- blocks -> numbers ----------------------------------------------------------

def shares(block: Block, i: int, n: int, n_words: int) -> tuple[float, ...]:
    text = block.text
    return (min(1.0, np.log1p(n_words) / 5), block.linked, float(text[-1] in ".!?…»”\"')。！？"), min(1.0, text.count(".") / 5), min(1.0, len(text) / 400),
            float("|" in text or "©" in text or "·" in text), i / n, 1 / n)


class Features:
    """Blocks of several pages as flat index arrays, for embedding sums."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = [len(p) for p in pages]
        path, words, path_at, word_at, numbers = [], [], [], [], []
        for page in pages:
            for i, b in enumerate(page):
                path_at.append(len(path))
                path += b.path
                word_at.append(len(words))
                ids = [_WORDS[w] for w in b.text.split(" ")]
                words += ids
                numbers.append(shares(b, i, len(page), len(ids)))
        self.path, self.words = np.array(path, np.int64), np.array(words, np.int64)
        self.path_at, self.word_at = np.array(path_at, np.int64), np.array(word_at, np.int64)
        self.shares = np.array(numbers, np.float32).reshape(-1, SHARES)

    def bags(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Marks by the root of their count, so that one name isn't lost on a long path; words by their count."""
        counts = [np.diff(np.append(at, len(ids))).astype(np.float32) for ids, at in ((self.path, self.path_at), (self.words, self.word_at))]
        return [(self.path, self.path_at, counts[0] ** -0.5), (self.words, self.word_at, 1 / counts[1])]

    def means(self, model: dict) -> np.ndarray:
        if not len(self.path_at):
            return np.zeros((0, DIM), np.float32)
        out = []
        for (ids, at, scale), table in zip(self.bags(), (model["path"], model["word"])):
            out.append(np.add.reduceat(table[ids], at, axis=0) * scale[:, None])
        return np.concatenate([*out, self.shares], axis=1)


# ---- the recurrent labeller -----------------------------------------------------

def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(scale, *shape):
        return (rng.standard_normal(shape) * scale).astype(np.float32)
    model = {"path": normal(0.5, PATHS, PATH_DIM), "word": normal(0.3, WORDS, WORD_DIM), "out": normal(0.2, 2 * HIDDEN + DIM), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        model |= {d + "x": normal(DIM ** -0.5, DIM, 4 * HIDDEN), d + "h": normal(HIDDEN ** -0.5, HIDDEN, 4 * HIDDEN), d + "c": np.zeros(4 * HIDDEN, np.float32)}
        model[d + "c"][HIDDEN:2 * HIDDEN] = 1  # remember by default
    return model


def lstm(x: np.ndarray, mask: np.ndarray, model: dict, d: str, tape: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) over time; masked steps carry the state on."""
    steps, width = x.shape[:2]
    H = HIDDEN
    drive = x @ model[d + "x"] + model[d + "c"]
    h = c = np.zeros((width, H), np.float32)
    out = np.zeros((steps, width, H), np.float32)
    for t in range(steps):
        z = drive[t] + h @ model[d + "h"]
        gates, g = sigmoid(z[:, :3 * H]), np.tanh(z[:, 3 * H:])
        i, f, o = gates[:, :H], gates[:, H:2 * H], gates[:, 2 * H:]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        m = mask[t][:, None]
        h_new = m * (o * tc) + (1 - m) * h
        if tape is not None:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = h_new, m * c_new + (1 - m) * c
        out[t] = h
    return out


def lstm_back(x: np.ndarray, grad: np.ndarray, tape: list, model: dict, d: str, into: dict) -> np.ndarray:
    H = HIDDEN
    dx = np.zeros_like(x)
    dh_next = dc_next = np.zeros((x.shape[1], H), np.float32)
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = grad[t] + dh_next
        da = dh * m
        dc = dc_next * m + da * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), da * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        into[d + "x"] += x[t].T @ dz
        into[d + "h"] += h.T @ dz
        into[d + "c"] += dz.sum(axis=0)
        dx[t] = dz @ model[d + "x"].T
        dh_next = dh * (1 - m) + dz @ model[d + "h"].T
        dc_next = dc * f + dc_next * (1 - m)
    return dx


def pad(flat: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(lengths)
    x = np.zeros((steps, len(lengths), flat.shape[1]), np.float32)
    mask = np.zeros((steps, len(lengths)), np.float32)
    at = 0
    for b, n in enumerate(lengths):
        x[:n, b], mask[:n, b] = flat[at:at + n], 1
        at += n
    return x, mask


def scores(features: Features, model: dict, tapes: dict | None = None) -> np.ndarray:
    """Article probability of every block, flat in page order."""
    if not sum(features.lengths):
        return np.zeros(0, np.float32)
    flat = features.means(model)
    x, mask = pad(flat, features.lengths)
    f_tape, b_tape = ([], []) if tapes is not None else (None, None)
    forward = lstm(x, mask, model, "f", f_tape)
    # the backward pass reads time reversed; padding then comes first and leaves the state at zero
    backward = lstm(x[::-1], mask[::-1], model, "b", b_tape)[::-1]
    whole = np.concatenate([forward, backward, x], axis=2)
    p = sigmoid(whole @ model["out"] + model["bias"])
    if tapes is not None:
        tapes.update(x=x, mask=mask, whole=whole, p=p, f=f_tape, b=b_tape)
    return np.concatenate([p[:n, b] for b, n in enumerate(features.lengths)])


def gradients(features: Features, labels: np.ndarray, model: dict) -> tuple[dict, float]:
    """Mean logistic loss over the blocks, and its gradients by backpropagation
    through time and into the vectors of marks and words."""
    t: dict = {}
    p = scores(features, model, t)
    n = len(labels)
    loss = float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))
    into = {k: np.zeros_like(v) for k, v in model.items()}
    delta = np.zeros_like(t["p"])
    at = 0
    for b, k in enumerate(features.lengths):
        delta[:k, b] = (p[at:at + k] - labels[at:at + k]) / n
        at += k
    into["out"] += np.tensordot(delta, t["whole"], 2)
    into["bias"] += delta.sum()
    grad = delta[:, :, None] * model["out"]
    dx = grad[:, :, 2 * HIDDEN:].copy()
    dx += lstm_back(t["x"], grad[:, :, :HIDDEN], t["f"], model, "f", into)
    dx += lstm_back(t["x"][::-1], grad[::-1, :, HIDDEN:2 * HIDDEN], t["b"], model, "b", into)[::-1]
    flat = np.concatenate([dx[:k, b] for b, k in enumerate(features.lengths)])
    for (ids, starts, scale), name, lo, hi in zip(features.bags(), ("path", "word"), (0, PATH_DIM), (PATH_DIM, PATH_DIM + WORD_DIM)):
        share = np.repeat(flat[:, lo:hi] * scale[:, None], np.diff(np.append(starts, len(ids))), axis=0)
        np.add.at(into[name], ids, share)
    return into, loss


def noisy(features: Features, rng: np.random.Generator) -> Features:
    """A copy in which some marks and words are exchanged for random ones, so that
    no block is known by a name or word alone."""
    out = copy.copy(features)
    for field, size, share in (("path", PATHS, 0.12), ("words", WORDS, 0.3)):
        ids = getattr(features, field).copy()
        hit = rng.random(len(ids)) < share
        ids[hit] = rng.integers(0, size, int(hit.sum()))
        setattr(out, field, ids)
    return out


def train(pages: list[tuple[list[Block], np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 24) -> dict[str, np.ndarray]:
    """Adam over pages in batches of like length; the same seed gives the same model."""
    rng = np.random.default_rng(7)
    model = initial(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
    groups = [(Features([p[0] for p in pages[i:i + batch]]), np.concatenate([p[1] for p in pages[i:i + batch]])) for i in range(0, len(pages), batch)]
    step = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            features, labels = groups[g]
            grads, _ = gradients(noisy(features, rng), labels, model)
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            step += 1
            lr = rate * (1 - epoch / epochs * 0.8)
            for k, v in grads.items():
                v *= min(1.0, 5 / (norm + 1e-9))
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                model[k] -= lr * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + (RARE if k == "word" else 1e-8))
    return model


# ---- labelled pages -------------------------------------------------------------

MARK = "\ue000"  # stands in article text of generated pages, and is taken out before features

# Names that pages give to their parts.
CONTENT = ("article", "content", "main", "post", "entry content", "story body", "article body", "post content", "text", "page content", "news item", "blog post", "main content", "article text", "body copy")
WRAPPERS = ("wrapper", "container", "page", "site", "row", "col", "inner", "layout", "grid", "outer", "section", "block", "clearfix", "main wrap")
NAVIGATION = ("nav", "menu", "navbar", "navigation", "top nav", "main menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip link", "links", "site nav", "tabs", "submenu")
HEADERS = ("header", "masthead", "site header", "topbar", "page header", "branding", "logo", "top", "site title", "hero banner")
FOOTERS = ("footer", "site footer", "copyright", "legal", "colophon", "site info", "bottom", "page footer", "credits", "imprint")
SIDEBARS = ("sidebar", "side", "widget", "related", "recommended", "trending", "popular", "most read", "read more", "see also", "teaser", "recent posts", "related posts", "side column", "right rail", "tags", "author box", "social", "share", "share buttons", "sharing")
ADVERTS = ("ad", "ads", "advert", "advertisement", "banner", "promo", "promotion", "sponsored", "sponsor", "ad slot", "ad container", "adsense", "commercial", "advertorial", "offer", "partner")
NOTICES = ("cookie", "cookie notice", "cookie banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "warning", "notification", "message", "privacy", "toast", "banner notice")
FORMS = ("search", "search form", "newsletter", "signup", "subscribe", "login", "contact form", "comment form", "register", "form", "poll", "survey")
COMMENTS = ("comments", "comment list", "comment", "commentlist", "replies", "reply", "responses", "disqus thread", "reviews", "user comments", "discussion", "reader comments", "feedback", "thread", "comment body", "comment text")
TITLES = ("title", "headline", "entry title", "post title", "article title", "page title", "heading", "entry header", "article header", "post header")
MODIFIERS = ("inline", "area", "box", "container", "wrapper", "wrap", "list", "item", "inner", "left", "right", "top", "bottom", "section", "block", "body", "text", "group", "panel", "module", "large", "small", "first", "last", "hidden", "content", "holder", "slot", "unit", "bar")
CUES = ("home about contact news login register search menu share follow subscribe copyright rights reserved privacy policy terms cookies accept advertisement sponsored "
        "related comments reply read more newsletter impressum datenschutz kontakt anmelden suche startseite accueil connexion mentions recherche inicio contacto buscar aviso legal").split()


def sample_page(rng: random.Random) -> str:
    """A page of invented words; article text begins with ``MARK`` in every block."""
    syllables = [rng.choice(("", *"bcdfghklmnprstvwz")) + rng.choice("aeiouyéüößñ") + rng.choice(("", *"nrslt")) for _ in range(60)]

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def words(n):
        return " ".join(word() for _ in range(n))

    def sentence():
        return words(rng.choice((2, 5, 8, 12, 20))).capitalize() + rng.choice("...!?")

    def prose():
        kind = rng.random()
        if kind < 0.06:
            return words(rng.randint(1, 4))
        if kind < 0.12:
            return " | ".join(word() for _ in range(rng.randint(2, 15)))
        if kind < 0.16:
            return words(rng.randint(3, 12)).upper() + rng.choice(("!!!", " $$$", " ### &amp;", ""))
        if kind < 0.2:
            return " ".join([word()] * rng.randint(2, 40)) + rng.choice(("", "."))
        if kind < 0.24:
            return sentence() + " &copy; &amp; &middot; " + rng.choice(CUES) + " " + sentence()
        return " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 8))))

    def name(kinds):
        n = rng.choice(kinds)
        if rng.random() < 0.35:
            n = f"{n} {rng.choice(MODIFIERS)}" if rng.random() < 0.7 else f"{rng.choice(MODIFIERS)} {n}"
        if rng.random() < 0.15:
            n += " " + word()
        n = n.title().replace(" ", "") if rng.random() < 0.1 else n.replace(" ", rng.choice(("-", "-", "_", "__", " ", "")))
        return n if rng.random() < 0.8 else f"{n}-{rng.randint(1, 99)}"

    def tag(names, kinds, semantic=(), plain=0.0):
        r = rng.random()
        if semantic and r < 0.35:
            t = rng.choice(semantic)
            return (f"<{t}>" if rng.random() < 0.6 else f'<{t} class="{name(kinds)}">'), f"</{t}>"
        if r > 1 - plain:
            return "<div>", "</div>"
        t = rng.choice(names)
        return f'<{t} {rng.choice(("class", "class", "id"))}="{name(kinds)}">', f"</{t}>"

    def links(n):
        label = lambda: rng.choice(CUES) if rng.random() < 0.35 else words(rng.randint(1, 3))
        items = [f'<a href="/{word()}">{label()}</a>' for _ in range(n)]
        style = rng.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items) if style < 0.8 else "".join(f"<div>{i}</div>" for i in items)

    def boiler(kinds, semantic=(), body=None, plain=0.0):
        a, b = tag(("div", "div", "section", "ul" if body is None else "div"), kinds, semantic, plain)
        if rng.random() < 0.06:
            a, b = f'<table><tr><td class="{name(kinds)}">', "</td></tr></table>"
        if body is not None and rng.random() < 0.25:
            a += rng.choice((f"<h3>{words(2)}</h3>", f"<h2>{words(3)}</h2>", f'<p class="{name(TITLES)}">{words(2)}</p>'))
        return a + (links(rng.randint(2, 9)) if body is None else body) + b

    def text_body():
        n = rng.choice((1, 1, 2, 3))
        cue = (" ".join(rng.sample(CUES, 3)) + " ") if rng.random() < 0.3 else ""
        inner = [cue + (" ".join([word()] * rng.randint(2, 30)) if rng.random() < 0.06 else " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4))))) for _ in range(n)]
        return inner[0] if n == 1 and rng.random() < 0.5 else "".join(f"<p>{s}</p>" for s in inner)

    def form():
        return f'<label>{word()}</label><input name="q"><p>{sentence()}</p><button>{rng.choice(CUES)}</button>'

    def comments():
        one = lambda: f'<div class="{name(COMMENTS)}"><b>{word()}</b> <span>{rng.randint(1, 28)}.{rng.randint(1, 12)}.</span><p>{text_body()}</p></div>'
        head = rng.choice(("", f"<h2>{words(3)}</h2>", f'<h3 class="{name(TITLES + COMMENTS)}">{rng.randint(1, 40)} {rng.choice(CUES)} {word()}</h3>', f"<p>{sentence()}</p>"))
        return head + "".join(one() if rng.random() < 0.7 else f"<li><p>{sentence()} {sentence()}</p></li>" for _ in range(rng.randint(1, 6)))

    def advert():
        return boiler(ADVERTS, ("aside",) if rng.random() < 0.2 else (), text_body())

    def article(title=True):
        out = []
        if title and rng.random() < 0.8:
            h = rng.choice(("h1", "h1", "h1", "h2"))
            title = f'<{h}{rng.choice(("", f' class="{name(TITLES)}"'))}>{MARK}{rng.choice((words(rng.randint(1, 9)), sentence()))}</{h}>'
            out.append(rng.choice((title, title, f"<header>{title}</header>", f'<div class="{name(TITLES)}">{title}</div>', f'<header class="{name(TITLES)}">{title}</header>')))
        for _ in range(rng.choice((1, 2, 4, 8, 14, 25))):
            r = rng.random()
            if r < 0.66:
                p = prose()
                if rng.random() < 0.2:
                    p = f"<b>{MARK}{p}<br>"  # not closed
                elif rng.random() < 0.2:
                    p = f'{MARK}{p} <a href="/x">{word()}</a> {prose()}'
                else:
                    p = MARK + p
                out.append(f"<p>{p}" + ("</p>" if rng.random() < 0.85 else ""))
            elif r < 0.72:
                out.append(f"<h2>{MARK}{words(rng.randint(1, 6))}</h2>")
            elif r < 0.78:
                k = rng.choice(("ul", "ol"))
                out.append(f"<{k}>" + "".join(f"<li>{MARK}{rng.choice((word, sentence))()}</li>" for _ in range(rng.randint(2, 6))) + f"</{k}>")
            elif r < 0.82:
                out.append(f"<blockquote><p>{MARK}{sentence()}</p></blockquote>" if rng.random() < 0.6 else f"<pre>{MARK}{words(9)}</pre>")
            elif r < 0.85:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{word()}</td><td>{MARK}{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif r < 0.88:
                out.append(f"<figure><img src='a.png'><figcaption>{MARK}{sentence()}</figcaption></figure>")
            elif r < 0.91:
                out.append(f"<div>{MARK}{prose()}</div>")
            elif r < 0.94:
                out.append(advert())
            elif r < 0.97:
                out.append(boiler(SIDEBARS, ("aside",)))
            else:
                out.append(boiler(FORMS, ("form",), form()))
        if rng.random() < 0.15:
            out.append(boiler(COMMENTS, (), comments()))
        return "".join(out)

    before, after_ = [], []
    for chance, make in ((0.7, lambda: boiler(NAVIGATION, ("nav", "nav", "menu"), plain=0.1)),
                         (0.5, lambda: boiler(HEADERS, ("header",), rng.choice((f"<h1>{words(2)}</h1>", f"<p>{sentence()}</p>", links(4), f'<a href="/">{word()}</a>')))),
                         (0.35, lambda: boiler(NOTICES, ("aside",) if rng.random() < 0.2 else (), text_body())),
                         (0.45, advert),
                         (0.2, lambda: boiler(FORMS, ("form",), form())),
                         (0.25, lambda: boiler(SIDEBARS, ("aside",), rng.choice((None, text_body()))))):
        if rng.random() < chance:
            before.append(make())
    for chance, make in ((0.3, lambda: boiler(COMMENTS, (), comments())),
                         (0.35, lambda: boiler(SIDEBARS, ("aside",), rng.choice((None, text_body())))),
                         (0.3, advert),
                         (0.2, lambda: boiler(FORMS, ("form",), form())),
                         (0.2, lambda: boiler(NOTICES, (), text_body())),
                         (0.2, lambda: boiler(NAVIGATION, ("nav",))),
                         (0.7, lambda: boiler(FOOTERS, ("footer", "footer"), rng.choice((f"&copy; {word()}.example &middot; {sentence()} {sentence()}", links(3), text_body()))))):
        if rng.random() < chance:
            after_.append(make())
    if rng.random() < 0.3:
        rng.shuffle(before)
    if rng.random() < 0.1:  # no article
        middle = boiler(SIDEBARS, ("aside",))
    else:
        a, b = tag(("div", "div", "section", "td"), CONTENT, ("article", "article", "article", "main"), plain=0.12)
        if a.startswith("<td"):
            a, b = "<table><tr>" + a, b + "</tr></table>"
        r = rng.random()
        if r < 0.05:
            a = b = ""
        if r < 0.25:  # the title stands before the article's own element
            h = rng.choice(("h1", "h1", "h2"))
            middle = f'<{h}{rng.choice(("", f' class="{name(TITLES)}"'))}>{MARK}{rng.choice((words(rng.randint(1, 9)), sentence()))}</{h}>' + a + article(False) + b
        else:
            middle = a + article() + b
    if rng.random() < 0.03:
        return rng.choice((MARK + prose(), "".join(f"<p>{MARK}{prose()}</p>" for _ in range(rng.randint(1, 6)))))
    page = "".join(before) + middle + "".join(after_)
    for _ in range(rng.choice((0, 0, 1, 2))):
        a, b = tag(("div",), WRAPPERS)
        page = a + page + b
    page = f"<html><head><title>{words(3)}</title></head><body>{page}"
    return page if rng.random() < 0.1 else page + "</body></html>"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    out = blocks(page)
    labels = np.array([MARK in b.text for b in out], np.float32)
    for b in out:
        b.text = b.text.replace(MARK, "") or "-"
    return out, labels


@functools.cache
def trained(pages: int = TRAIN_PAGES, seed: int = 11) -> dict[str, np.ndarray]:
    rng = random.Random(seed)
    return train([labelled(sample_page(rng)) for _ in range(pages)])


# ---- extraction -----------------------------------------------------------------

GROUP = 48


def main_texts(pages: list[str | None], model: dict) -> list[str]:
    """The main text of every page; pages of like length share a pass."""
    all_blocks = [blocks(p or "") for p in pages]
    order = sorted((i for i, b in enumerate(all_blocks) if b), key=lambda i: len(all_blocks[i]))
    out = [""] * len(pages)
    for at in range(0, len(order), GROUP):
        these = order[at:at + GROUP]
        p = scores(Features([all_blocks[i] for i in these]), model)
        k = 0
        for i in these:
            n = len(all_blocks[i])
            out[i] = " ".join(b.text for b, s in zip(all_blocks[i], p[k:k + n].tolist()) if s >= 0.5)
            k += n
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Every column of ``pages`` in a struct ``row``, and its main text ``extracted``."""
    model = trained()
    rows = pages.select(F.struct("*").alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("extracted", T.StringType())])

    def make():
        return lambda batch: [batch.column("row"), main_texts([None if h is None else str(h) for h in batch.column("row").field("html").to_pylist()], model)]

    return map_batches(rows, make, schema, rows=256)


def op12_recurrent_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select("row.page_id", "row.url", F.col("extracted").alias("text"), F.length("extracted").cast("long").alias("n_chars"))
