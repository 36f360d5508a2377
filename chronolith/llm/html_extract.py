"""Main text of web pages by maximum-scoring subsequence.

A page is read once into tokens: words, which score positive, and tags, which score negative. What scores how much is learned
from labelled pages: those with one `article` element say which tokens are content. A linear scan finds the contiguous run of tokens
with the greatest sum (`best_run`), and its edges move to those of the element that holds it: an `article` or `main` that has most of its
words, or else the neighbouring blocks of its own container up to a list of links.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever they stand, by
element, by role, or by a word of their class or id (fixed lists below).

Defined results: null and empty html, and pages without words outside of what is left out, give an empty text; a tag or comment that isn't
closed ends with the page, a quote that isn't closed is none; unknown character references stay as they are; repeated rows give repeated results. Scanning is linear in the page,
whose size has no limit. `keep` columns come back unchanged; they may not be called `text` or `n_chars` (an error says so). An empty table gives an empty result.
Texts are Unicode white space normalised, a no-break space included.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, tidy

# ---------------------------------------------------------------- fixed values: names of elements, words of classes and ids

VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript template".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDER = set("article aside body dd div dl figure footer form header html li main nav ol section table tbody td tr ul".split())
#: An element that an opening tag closes, if it is open in the same holder.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEFT_OUT = set("nav footer aside form dialog button select svg math canvas audio video object menu head search".split()) | RAW
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
LEFT_OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended teaser widget "
    "comment comments commentlist commentary disqus reply replies respond discussion footer copyright skip toolbar tags metadata form search".split()
)
HEADER_WORDS = set("header masthead topbar branding logo".split())
TAG_CLASS = {
    **dict.fromkeys(("p", "br", "blockquote", "pre"), "tag:p"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "tag:h"), **dict.fromkeys(("li", "ul", "ol", "dl", "dt", "dd", "menu"), "tag:li"),
    **dict.fromkeys(("table", "tr", "td", "th", "tbody", "thead", "tfoot"), "tag:table"), **dict.fromkeys(("div", "section", "article", "main", "body", "html"), "tag:div"), "a": "tag:a",
}
#: Scores for tables without labelled pages.
PLAIN = {"word": 1.0, "link": 0.1, "tag:p": -0.5, "tag:h": -0.5, "tag:li": -2.0, "tag:table": -2.0, "tag:div": -3.0, "tag:a": -2.0, "tag:inline": -0.5}

# ---------------------------------------------------------------- a page as tokens

_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, name with `/` if it ends an element, attributes) of each tag, comments and raw texts passed over; last ("text", "", "")."""
    pos, from_, n = 0, 0, len(page)
    closing = {'"': True, "'": True}  # whether such a quote may still follow
    text = []
    while True:
        i = page.find("<", pos)
        if i < 0:
            text.append(page[from_:])
            yield "".join(text), "", ""
            return
        if page.startswith("<!--", i):
            text.append(page[from_:i])
            j = page.find("-->", i + 4)
            pos = from_ = n if j < 0 else j + 3
            continue
        end = page.startswith("/", i + 1)
        name = _NAME.match(page, i + 1 + end)
        if name is None and page[i + 1 : i + 2] not in ("!", "?", "/"):
            pos = i + 1  # a plain <
            continue
        k = name.end() if name else i + 2
        while True:
            stop = _STOP.search(page, k)
            if stop is None:
                k = n
                break
            if stop[0] == ">" or not name:
                k = stop.end()
                if stop[0] == ">":
                    break
                continue
            quote, close = stop[0], -1
            if closing[quote] and page[k : stop.start()].rstrip().endswith("="):
                close = page.find(quote, stop.end())
                closing[quote] = close >= 0
            k = close + 1 if close >= 0 else stop.end()
        text.append(page[from_:i])
        pos = from_ = k
        if not name:
            continue
        low = name[0].lower()
        yield "".join(text), ("/" if end else "") + low, page[name.end() : max(name.end(), k - 1)]
        text = []
        if not end and low in RAW:
            close = re.compile(rf"</{low}(?![^\s/>])", re.IGNORECASE).search(page, k)
            pos = from_ = close.start() if close else n


def parts(value: str) -> set[str]:
    return {p.lower() for p in _PART.findall(value)}


def left_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is none of the article's; inside: it stands in an article or main."""
    if name in LEFT_OUT or (name == "header" and not inside):
        return True
    if not attributes.strip():
        return False
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.IGNORECASE):
        return name not in ("html", "body")
    if a.get("role", "").lower() in LEFT_OUT_ROLES:
        return name not in ("html", "body", "main")
    words = parts(a.get("class", "")) | parts(a.get("id", ""))
    if name in ("html", "body", "main") or (name == "article" and not inside):
        return False
    return bool(words & LEFT_OUT_WORDS) or (not inside and bool(words & HEADER_WORDS))


@dataclass
class Block:
    text: str
    counts: Counter  # its words and inline tags
    before: Counter  # tags between the block before and it
    holder: int  # number of the innermost holder around it, 0 for none
    between: int  # number of the innermost holder around it and the block before it
    out: bool  # in something that is left out
    article: int  # number of the outermost article or main around it, -1 if none


def blocks(page: str) -> tuple[list[Block], list[tuple[str, int]]]:
    """A page's blocks that have words, those that are left out too, and (name, depth) of its holders by number."""
    found: list[Block] = []
    held: list[tuple[str, int]] = [("", 0)]
    around = [0]
    between = 0
    open_: list[tuple[str, bool, int]] = []  # (name, left out, holder number or -1)
    count: Counter = Counter()
    out = links = 0
    articles: list[int] = []
    runs: list[str] = []
    inner, before = Counter(), Counter()

    def flush():
        nonlocal runs, inner, before, between
        text = " ".join("".join(runs).split()) if runs else ""
        runs = []
        if text:
            found.append(Block(text, inner, before, around[-1], between, out > 0, articles[0] if articles else -1))
            inner, before, between = Counter(), Counter(), around[-1]
        else:
            before.update({k: v for k, v in inner.items() if k.startswith("tag")})
            inner = Counter()

    def close(depth: int):
        nonlocal out, links, between
        while len(open_) > depth:
            name, was_out, number = open_.pop()
            count[name] -= 1
            out -= was_out
            links -= name == "a"
            if number >= 0:
                around.pop()
                between = min(between, around[-1], key=lambda k: held[k][1])
            if articles and number == articles[-1]:
                articles.pop()

    for text, name, attributes in tags(page):
        if text:
            text = references.unescape(text)
            runs.append(text)
            inner["link" if links else "word"] += len(text.split())
        plain = name.lstrip("/")
        if plain in BLOCK:
            flush()
        if not name:
            flush()
            break
        (before if plain in BLOCK else inner)[TAG_CLASS.get(plain, "tag:inline")] += 1
        if plain == "br":
            runs.append(" ")
        if name[0] == "/":
            if count[plain]:
                depth = len(open_) - 1
                while depth >= 0 and open_[depth][0] != plain and (plain in BLOCK or open_[depth][0] not in BLOCK):
                    depth -= 1
                if depth >= 0 and open_[depth][0] == plain:
                    close(depth)
        elif plain not in VOID:
            shut = CLOSES.get(plain, set()) | ({"p"} if plain in BLOCK else set())
            if any(count[s] for s in shut):
                depth, at = len(open_) - 1, -1
                while depth >= 0 and (open_[depth][0] not in HOLDER or open_[depth][0] in shut):
                    at = depth if open_[depth][0] in shut else at
                    depth -= 1
                if at >= 0:
                    close(at)
            if attributes.rstrip().endswith("/") and plain not in BLOCK:
                continue
            number = -1
            if plain in HOLDER:
                number = len(held)
                held.append((plain, len(around)))
                around.append(number)
            is_out = left_out(plain, attributes, bool(articles))
            if plain in ("article", "main"):
                articles.append(number)
            open_.append((plain, is_out, number))
            count[plain] += 1
            out += is_out
            links += plain == "a"
    return found, held


# ---------------------------------------------------------------- scores


def tallies(page: str) -> tuple[Counter, Counter] | None:
    """Tokens (inside, outside) of the only article of a page; None if it has none, or several."""
    found, held = blocks(page)
    if sum(name in ("article", "main") for name, _ in held) != 1:
        return None
    inside, outside = Counter(), Counter()
    for b in found:
        to = inside if b.article >= 0 and not b.out else outside
        to.update(b.counts)
        to.update(b.before)
    return (inside, outside) if inside["word"] else None


def scores(inside: Counter, outside: Counter) -> dict[str, float]:
    """Logarithms of how much likelier a token is in an article, words held above zero and tags below."""
    if not inside or not outside:
        return dict(PLAIN)
    a, b, kinds = sum(inside.values()), sum(outside.values()), len(PLAIN)
    out = {}
    for k in PLAIN:
        odds = math.log((inside[k] + 1) / (a + kinds)) - math.log((outside[k] + 1) / (b + kinds))
        out[k] = min(-0.05, max(-6.0, odds)) if k.startswith("tag") else max(0.05, min(2.0, odds))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous values with the greatest sum, the first of equals; (0, 0) if none is positive."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for k, v in enumerate(values):
        if total <= 0:
            total, begin = 0.0, k
        total += v
        if total > best:
            best, at = total, (begin, k + 1)
    return at


def article(page: str | None, weights: dict[str, float]) -> list[str]:
    """The blocks of a page's main text."""
    every, held = blocks(page or "")
    deep = lambda k: held[k][1]
    found, between = [], None
    for b in every:
        between = b.between if between is None else min(between, b.between, key=deep)
        if not b.out:
            b.between, between = between, None
            found.append(b)
    values = [sum(weights[k] * n for k, n in c.items()) for b in found for c in (b.before, b.counts)]
    first, end = best_run(values)
    run = [k for k in range(first // 2, (end + 1) // 2) if first <= 2 * k + 1 < end]
    if not run:
        return []
    words = lambda b: b.counts["word"] + b.counts["link"]
    of = Counter()
    for k in run:
        of[found[k].article] += words(found[k])
    most, number = max(((v, -k) for k, v in of.items() if k >= 0), default=(0, 0))
    if most and 2 * most >= sum(of.values()):
        return [b.text for b in found if b.article == -number]
    around = min([found[run[0]].holder, *[found[k].between for k in run[1:]]], key=deep)
    page_wide = held[around][0] in ("", "body", "html")
    near = lambda b, between: deep(between) >= deep(around) and (b.holder == around or not page_wide) and 2 * b.counts["link"] < words(b)
    low, high = run[0], run[-1] + 1
    while low > 0 and near(found[low - 1], found[low].between):
        low -= 1
    while high < len(found) and near(found[high], found[high].between):
        high += 1
    return [b.text for b in found[low:high]]


# ---------------------------------------------------------------- tables


@dataclass
class Sample:
    """The labelled pages that scores are learned from: at most so many different ones, of at most so many characters, those of the least hash."""

    pages: int = 500
    chars: int = 1 << 16


def learn(pages: DataFrame, html_col: str = "html", sample: Sample | None = None) -> dict[str, float]:
    """Scores of tokens, counted in the executors over a bounded sample of labelled pages."""
    ship(pages.sparkSession)
    sample = sample or Sample()
    some = pages.select(F.col(html_col).cast("string").alias("html")).where((F.length("html") <= sample.chars) & F.col("html").rlike("(?i)<article[\\s>]"))
    some = some.withColumn("h", F.xxhash64("html"))
    # the last hash of the sample is found first, without the pages; copies of a page are one
    last = some.select("h").distinct().orderBy("h").limit(sample.pages).agg(F.max("h")).first()[0]
    some = some.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.first("html").alias("html")).select("html")

    def count(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch["html"]:
                if (both := tallies(page.as_py())) is not None:
                    inside.update(both[0])
                    outside.update(both[1])
        yield pa.RecordBatch.from_arrays([pa.array(list(PLAIN)), pa.array([inside[k] for k in PLAIN], pa.int64()), pa.array([outside[k] for k in PLAIN], pa.int64())], ["kind", "inside", "outside"])

    got = some.mapInArrow(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return scores(Counter({r["kind"]: r["inside"] for r in got if r["inside"]}), Counter({r["kind"]: r["outside"] for r in got if r["outside"]}))


def html_extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars of every row of pages. One pass without a shuffle."""
    if clash := {"text", "n_chars"} & set(keep):
        raise ValueError(f"columns to keep can't be called {sorted(clash)}")
    ship(pages.sparkSession)
    d = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]), "text string", "n_chars long"])

    def extract(batches):
        for batch in batches:
            kept, column = batch.columns[:-1], batch.column(batch.num_columns - 1)
            begin, size, texts = 0, 0, []
            for k, page in enumerate(column, 1):  # pages one at a time, and results in parts of a few MB
                texts.append("\n\n".join(article(page.as_py(), weights)))
                size += len(texts[-1])
                if size > 1 << 21 or k == len(column):
                    made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*[c.slice(begin, k - begin) for c in kept], *made], names=[*batch.schema.names[:-1], "text", "n_chars"])
                    begin, size, texts = k, 0, []

    return d.mapInArrow(extract, schema)


@tidy
def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by scores learned from at most 500 pages that have an article element."""
    pages = table(spark, sf_dir, "pages")
    return html_extract(pages, learn(pages))
