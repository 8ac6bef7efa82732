"""Main text of web pages by a linear-chain conditional random field over leaf blocks of the element tree.

A page is cut into blocks: runs of text between block-level tags, each with the open elements above it. Features are the
ancestors' tags and the words of their classes and ids, and figures of the text. The field has two labels, text and rest,
weights for features and for transitions, is trained by gradient ascent on the likelihood of labelled pages, and is
decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Labelled pages that the field is trained on, rounds over them and the generator's seed.
TRAIN_PAGES = 600
ROUNDS = 12
SEED = 7

# Fixed values of the HTML standard: elements without an end tag, elements whose content is no text of the page,
# elements that start a block, and start tags that end an open element of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template textarea select button iframe svg object canvas title".split())
RAW = "script|style|textarea|title|noscript|template|iframe"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that bound the search for an element to end.
SCOPE = frozenset("ul ol dl table article section div aside nav main header footer body html".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


def attributes(text: str) -> tuple[tuple[str, ...], str | None]:
    """(words of class, id and role; training label) of a tag's attributes."""
    words: list[str] = []
    label = None
    if "=" in text:
        for name, a, b, c in NAMES.findall(text):
            if name.lower() == "data-label":
                label = a or b or c
            else:
                words += WORD.findall((a or b or c).lower())
    return tuple(words), label


def blocks(page: str | None) -> list[tuple[tuple, str, int, str | None]]:
    """(path, text, characters inside links, label) of each leaf block that has text.

    ``path``: (tag, words) of the open elements. Character references are decoded, white space becomes one space, ends are trimmed.
    Unknown and unclosed tags are tolerated: an end tag closes up to its element if that is open, a block ends a paragraph. A tag
    with a quote that is never closed ends at its first >, without attributes.
    """
    if not page:
        return []
    out: list[tuple[tuple, str, int, str | None]] = []
    stack: list[tuple[str, tuple[str, ...], str | None]] = []
    parts: list[str] = []
    linked = hidden = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                label = next((s[2] for s in reversed(stack) if s[2]), None)
                out.append((tuple((s[0], s[1]) for s in stack), text, min(linked, len(text)), label))
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal hidden, links
        for s in stack[i:]:
            hidden -= s[0] in HIDDEN
            links -= s[0] == "a"
        del stack[i:]

    def close(tags: set[str] | frozenset[str], within: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                pop_to(i)
                return
            if stack[i][0] in within:
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not hidden:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag, attrs = m["tag"] or m["tag2"], m["attrs"] or ""
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["end"] or m["end2"]:
            if tag in BLOCK or any(s[0] == tag for s in stack):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            close({"p"}, SCOPE)
            if tag[0] == "h" and tag[1:].isdigit():
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, SCOPE)
            if tag in SELF_CLOSING:
                close(SELF_CLOSING[tag], SCOPE)
            if tag == "body":
                close({"head"}, frozenset())
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        words, label = attributes(attrs)
        stack.append((tag, words, label))
        hidden += tag in HIDDEN
        links += tag == "a"
    if not hidden and at < len(page):
        parts.append(page[at:])
    flush()
    return out


def path_features(path: tuple) -> list[str]:
    found = {f"in:{tag}" for tag, _ in path if tag not in ("html", "body")}
    found |= {f"name:{w}" for _, words in path for w in words}
    found |= {f"pair:{w}:{tag}" for tag, words in path for w in words}
    tags = [t for t, _ in path if t in BLOCK]
    found.add(f"leaf:{tags[-1] if tags else ''}")
    found.add(f"leaf2:{'>'.join(tags[-2:])}")
    if not any(t in ("article", "main", "section") for t in tags):
        found.add("no-article")
    return sorted(found)


def text_features(text: str, linked: int, place: int, count: int) -> list[str]:
    share = linked / len(text)
    return [
        f"size:{len(text).bit_length()}",
        f"prose:{min(4, len(text.split()).bit_length())}:{min(2, text.count('. '))}:{share < 0.3}",
        f"links:{0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"end:{text[-1] if text[-1] in '.!?:,;' else 'w'}",
        f"place:{0 if not place else 2 if place == count - 1 else 1}",
        "copyright" if "©" in text else "plain",
    ]


def features_of(found: list[tuple[tuple, str, int, str | None]]) -> list[list[str]]:
    """The features of a page's blocks but for those of their paths."""
    n = len(found)
    return [text_features(t, k, i, n) for i, (_, t, k, _) in enumerate(found)]


class Field:
    """Weights of the label ``text`` against ``rest`` by feature, and of transitions [from][to], start included as row 2."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
        self._paths: dict[tuple, float] = {}

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def path_score(self, path: tuple) -> float:
        found = self._paths.get(path)
        if found is None:
            if len(self._paths) > 20_000:
                self._paths.clear()
            found = self._paths[path] = self.score(path_features(path))
        return found

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the likeliest labels, 1 for text, for the blocks' scores."""
        (s00, s01), (s10, s11), (b0, b1) = self.moves
        rest, text, back = b0, b1, []
        for i, x in enumerate(scores):
            if i:
                from0, from1 = rest + s00 >= text + s10, rest + s01 >= text + s11
                rest, text = (rest + s00 if from0 else text + s10), (rest + s01 if from1 else text + s11)
                back.append((0 if from0 else 1, 0 if from1 else 1))
            text += x
        label = int(text > rest)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def gradient(self, scores: list[float], gold: list[int]) -> tuple[list[float], list[list[float]]]:
        """Observed less expected counts by forward-backward: of the label text for each block, and of each transition."""
        n, move = len(scores), self.moves
        emit = [(0.0, s) for s in scores]

        def add(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        ahead = [(move[2][0], move[2][1] + emit[0][1])]
        for i in range(1, n):
            ahead.append(tuple(add(ahead[-1][0] + move[0][y], ahead[-1][1] + move[1][y]) + emit[i][y] for y in (0, 1)))
        behind = [(0.0, 0.0)]
        for i in range(n - 1, 0, -1):
            b = behind[-1]
            behind.append(tuple(add(move[y][0] + emit[i][0] + b[0], move[y][1] + emit[i][1] + b[1]) for y in (0, 1)))
        behind.reverse()
        total = add(*ahead[-1])
        of_text = [gold[i] - math.exp(ahead[i][1] + behind[i][1] - total) for i in range(n)]
        steps = [[0.0, 0.0] for _ in range(3)]
        for y in (0, 1):
            steps[2][y] = (gold[0] == y) - math.exp(ahead[0][y] + behind[0][y] - total)
        for i in range(1, n):
            for x in (0, 1):
                for y in (0, 1):
                    steps[x][y] += (gold[i - 1] == x and gold[i] == y) - math.exp(ahead[i - 1][x] + move[x][y] + emit[i][y] + behind[i][y] - total)
        return of_text, steps

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int, rate: float = 0.5, shrink: float = 1e-4) -> None:
        """Gradient ascent with a step for each weight by its own past gradients."""
        past: dict[str, float] = {}
        past_moves = [[1e-6, 1e-6] for _ in range(3)]
        for _ in range(rounds):
            for features, gold in pages:
                scores = [self.score(f) for f in features]
                of_text, steps = self.gradient(scores, gold)
                change: dict[str, float] = {}
                for names, g in zip(features, of_text):
                    if g:
                        for f in names:
                            change[f] = change.get(f, 0.0) + g
                for f, g in change.items():
                    w = self.weights.get(f, 0.0)
                    g -= shrink * w
                    past[f] = past.get(f, 1e-6) + g * g
                    self.weights[f] = w + rate * g / math.sqrt(past[f])
                for x in range(3):
                    for y in (0, 1):
                        past_moves[x][y] += steps[x][y] ** 2
                        self.moves[x][y] += rate * steps[x][y] / math.sqrt(past_moves[x][y])


#: Layouts of made-up pages: elements and names that say what they are, no names, made-up names, and tables.
FAMILIES = ("named", "nameless", "odd", "table")
SYLLABLES = "an the er on re in ti es or te at is la de que ment ung lich cion ado".split()


def labelled_page(rng: random.Random, family: str | None = None) -> str:
    """A made-up page of a family, or of any, whose leaf elements carry data-label="text" or "rest"."""
    family = family or rng.choice(("named",) * 3 + FAMILIES[1:])

    def sentence(low: int = 1, high: int = 30) -> str:
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return (" ".join(words)).capitalize() + rng.choice([".", ".", ".", ",", "", " |", "!"])

    def prose(high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, high)))

    def leaf(tag: str, text: str, label: str) -> str:
        return f'<{tag} data-label="{label}">{text}</{tag}>'

    def menu() -> str:
        items = "".join(f'<li><a data-label="rest" href="/x">{sentence(1, 2)}</a></li>' for _ in range(rng.randint(2, 8)))
        return rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="nav">{}</ul>', '<div id="navigation"><ul>{}</ul></div>']).format(items)

    def named(names: str, body: str, tags: str = "div section aside") -> str:
        return f'<{(t := rng.choice(tags.split()))} class="{rng.choice(names.split())}">{body}</{t}>'

    def rest() -> str:
        text = lambda tag="p": leaf(tag, prose(2), "rest")
        bare = leaf("span", prose(2), "rest")
        return rng.choice(
            [
                menu,
                lambda: named("ad ads advert banner promo sponsored", rng.choice([bare, text()])),
                lambda: f"<header>{leaf('div', sentence(1, 5), 'rest')}{menu()}</header>",
                lambda: named("header masthead topbar", leaf("h2", sentence(1, 4), "rest") + text()),
                lambda: f"<aside>{leaf('h3', sentence(1, 3), 'rest')}{text()}{menu()}</aside>",
                lambda: named("sidebar widget related", leaf("h3", sentence(1, 3), "rest") + text() + menu()),
                lambda: named("cookie notice consent alert newsletter subscribe", text() + leaf("a", sentence(1, 2), "rest")),
                lambda: f"<form>{leaf('label', sentence(1, 3), 'rest')}<input name=q>{leaf('p', sentence(), 'rest')}<button>{sentence(1, 2)}</button></form>",
                lambda: named("share social tags breadcrumb breadcrumbs", "".join(f'<a data-label="rest" href="#">{sentence(1, 1)}</a> ' for _ in range(4))),
            ]
        )()

    def plain_rest() -> str:
        """What is no text even without a name: links, forms, elements that say so, a line or two."""
        link = lambda: f'<a data-label="rest" href="/z">{sentence(1, 3)}</a>'
        return rng.choice(
            [
                menu,
                lambda: f"<nav>{' '.join(link() for _ in range(5))}</nav>",
                lambda: f"<div>{' | '.join(link() for _ in range(rng.randint(2, 6)))}</div>",
                lambda: f"<header>{leaf('div', sentence(1, 5), 'rest')}</header>",
                lambda: f"<aside>{leaf('h3', sentence(1, 3), 'rest')}{leaf('p', sentence(), 'rest')}</aside>",
                lambda: f"<form>{leaf('label', sentence(1, 3), 'rest')}<input name=q><button>{sentence(1, 2)}</button></form>",
                lambda: f"<div>{leaf('div', sentence(1, 4), 'rest')}</div>",
                lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
            ]
        )()

    def comments() -> str:
        one = lambda: named("comment reply", leaf("b", sentence(1, 2), "rest") + leaf("p", prose(3), "rest"), "div li article")
        inner = leaf("h3", sentence(1, 3), "rest") + "".join(rng.choice([one(), leaf("p", prose(2), "rest"), leaf("div", prose(2), "rest")]) for _ in range(rng.randint(1, 4)))
        attribute = rng.choice(["class", "id"])
        name = rng.choice("comments comments discussion responses respond disqus_thread comment-list replies reply-title comment-form".split())
        return f'<{(t := rng.choice(["div", "section", "ol"]))} {attribute}="{name}">{inner}</{t}>'

    def story() -> str:
        body = [leaf(rng.choice(["h1", "h1", "h2"]), sentence(2, 12), "text")] if rng.random() < 0.9 else []
        part = "div" if family != "named" and rng.random() < 0.4 else "p"
        for _ in range(rng.randint(1, 9) if family == "named" else rng.randint(2, 9)):
            kind = rng.random()
            if kind < 0.78:
                body.append(leaf(part, prose() if rng.random() < 0.75 or family != "named" else sentence(1, 2), "text"))
            elif kind < 0.84:
                body.append(leaf("h2", sentence(1, 6), "text"))
            elif kind < 0.9:
                body.append("<ul>" + "".join(leaf("li", sentence(1, 12), "text") for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                body.append("<blockquote>" + leaf("p", prose(3), "text") + "</blockquote>")
            elif kind < 0.97:
                body.append(f'<p data-label="text"><b>{prose(3)}<br></b> <a href="/y">{sentence(1, 2)}</a></p>')
            else:
                body.append(named("ad advert promo", leaf("span", prose(2), "rest"), "div"))
        if family == "named" and rng.random() < 0.12:  # a line or two are an article too
            body = [leaf("p", sentence(1, 2), "text") for _ in range(rng.randint(1, 2))]
        inner = "".join(body)
        if family == "table":
            side = f"<td>{menu()}</td>" if rng.random() < 0.5 else ""
            return f"<table><tr>{side}<td>{inner}</td></tr></table>"
        if family == "nameless":
            depth = rng.randint(1, 3)
            return "<div>" * depth + inner + "</div>" * depth
        if family == "odd":
            names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 3))]
            return "".join(f'<div class="{n}">' for n in names) + inner + "</div>" * len(names)
        return rng.choice(
            [f"<article>{inner}</article>"] * 4
            + [f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="content">{inner}</div>', f'<div id="content"><div class="post">{inner}</div></div>', f'<div class="article body">{inner}</div>', f'<div class="entry content">{inner}</div>', f'<section class="story">{inner}</section>', f'<article class="post">{inner}</article>']
        )

    foot = rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>']).format(leaf("span", "&copy; " + prose(2), "rest"))
    around = rest if family == "named" else plain_rest
    parts = [around() for _ in range(rng.randint(0, 4))] + [story()] + ([comments()] if rng.random() < 0.4 else []) + [around() for _ in range(rng.randint(0, 2))] + [foot]
    return f"<html><head><title>{sentence(1, 6)}</title></head><body>{''.join(parts)}</body></html>"


@cache
def field(pages: int = TRAIN_PAGES, rounds: int = ROUNDS, seed: int = SEED, without: str = "") -> Field:
    """The trained field; the same arguments give the same weights everywhere. ``without``: a family that it does not see."""
    rng = random.Random(seed)
    made = []
    while len(made) < pages:
        family = rng.choice(("named",) * 3 + FAMILIES[1:])
        if family == without:
            continue
        found = blocks(labelled_page(rng, family))
        made.append(([path_features(p) + f for (p, *_), f in zip(found, features_of(found))], [int(label == "text") for *_, label in found]))
    out = Field()
    out.train([m for m in made if m[1]], rounds)
    return out


def scores_of(found: list[tuple[tuple, str, int, str | None]], own: Field) -> list[float]:
    return [own.path_score(p) + own.score(f) for (p, *_), f in zip(found, features_of(found))]


def main_text(page: str | None, own: Field) -> str:
    found = blocks(page)
    scores = scores_of(found, own)
    return "\n".join(b[1] for b, label in zip(found, own.decode(scores) if found else []) if label)


def extract(pages: DataFrame, own: Field | None = None) -> DataFrame:
    """All columns of ``pages`` but html, with text and n_chars (its code points), for every row.

    Null and empty html give an empty text, as do pages without a block of text. Whole pages are read, and nothing found is dropped
    or cut. Repeated rows get equal results. Columns named text or n_chars are replaced.
    """
    common.bounded_batches(pages.sparkSession)
    weights = own or field()
    base = pages.select(*[c for c in pages.columns if c.lower() not in ("text", "n_chars")])
    at = base.columns.index("html")
    keep = [i for i in range(len(base.columns)) if i != at]
    shared = pages.sparkSession.sparkContext.broadcast((weights.weights, weights.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field()
        f.weights, f.moves = shared.value
        for batch in common.text_batches(batches):
            texts = [main_text(p, f) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(batch.schema.names[i] for i in keep), "text", "n_chars"])

    kinds = ", ".join(f"`{base.columns[i]}` {base.schema[i].dataType.simpleString()}" for i in keep)
    return base.mapInArrow(run, f"{kinds}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
