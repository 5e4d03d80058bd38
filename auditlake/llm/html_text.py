"""Main text of web pages: flat text blocks, classified by a decision tree on word counts and link densities."""

from __future__ import annotations

import bisect
import html
import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Elements whose content is never text of the page.
HIDDEN = {"script", "style", "noscript", "template", "title", "textarea", "select", "option", "button", "svg", "math", "iframe", "object", "canvas"}
#: Elements that start and end a block.
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Of these the open ones are remembered.
CONTAINER = set("article aside blockquote body center details dialog div dl fieldset figure footer form header html main nav ol section table ul".split())
BOILER_TAGS = {"nav", "aside", "footer", "form", "dialog", "fieldset"}
MAIN_TAGS = {"article", "main"}
#: Words of class, id and role that mark containers beside, or of, the article.
BOILER_WORDS = set("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets alert".split())
MAIN_WORDS = set("article articlebody content entry main post story".split())
#: A class that starts with one of these tells what a container has inside.
HAS_WORDS = {"has", "have", "no", "with", "without"}
#: How sure a mark is: a WEAK one is taken back by an article inside, a STRONG one only by the page's main element.
WEAK, STRONG = 1, 2
#: Boilerplate elements that some pages have around everything.
WEAK_TAGS = {"form", "fieldset", "dialog"}
SPACE = " "

_START = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_PLAIN, _QUOTE = re.compile(r"[^<>]*>"), re.compile("[\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")

FEATURES = ["words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "in_boiler", "in_main", "heading", "header"]


def _kind(tag: str, attributes: str) -> tuple[int, bool, bool]:
    """How sure a container is beside the article, whether it is the article, whether it is a header.

    The whole page and its body are neither. A name of several words, as in "comments-open", marks a container less than
    one of a single word, and not at all if the container has a name of the article too.
    """
    if tag in ("html", "body"):
        return 0, False, False
    beside, main, marks = 0, False, set()
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id", "role"):
                for name in (m[2] or m[3] or m[4] or "").lower().split():
                    words = _WORD.findall(name)
                    marks.update(words)
                    if not words or words[0] in HAS_WORDS:
                        continue
                    if not BOILER_WORDS.isdisjoint(words):
                        beside = max(beside, STRONG if len(words) == 1 else WEAK)
                    elif not MAIN_WORDS.isdisjoint(words):
                        main = True
    if tag == "main" or main and beside == WEAK:
        beside = 0
    if tag in BOILER_TAGS:
        beside = max(beside, WEAK if tag in WEAK_TAGS else STRONG)
    return beside, tag in MAIN_TAGS or main and not beside, tag == "header" or "header" in marks


class _Markup:
    """Elements, comments and sections of a page one after another, each place of the page being looked at a fixed number of times.

    A tag ends at the first > outside quotes, or, where quotes never close before one, at the first > if no < comes before.
    A search that meets no such > to the end of the page is remembered with its quotes: one that starts outside of them
    would meet none either. As a quote moves what stands within double, within single and without quotes to different places,
    no more than three searches differ.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.failed: list[tuple[int, list[int], list[int]]] = []

    def _end(self, at: int) -> int:
        if at > self.last:
            return -1
        for begin, opens, closes in self.failed:
            i = bisect.bisect_left(opens, at) - 1
            if at >= begin and not (i >= 0 and at <= closes[i]):
                return -1
        if m := _REST.match(self.page, at):
            return m.end()
        opens, closes, place = [], [], at
        while q := _QUOTE.search(self.page, place):
            end = self.page.find(q[0], q.end())
            opens.append(q.start())
            closes.append(end if end >= 0 else len(self.page))
            place = closes[-1] + 1
        self.failed.append((at, opens, closes))
        return -1

    def find(self, at: int) -> tuple[int, int, str, bool, str, str] | None:
        """Start, end, name, whether it closes, attributes, and text of a section, of what comes next."""
        page = self.page
        while m := _START.search(page, at):
            begin, at = m.span()
            if m[2]:
                end = self._end(at)
                if end < 0 and at <= self.last and (plain := _PLAIN.match(page, at)):
                    end = plain.end()
                if end >= 0:
                    return begin, end, m[2].lower(), bool(m[1]), page[at : end - 1], ""
                continue
            mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(mark, at)
            if end >= 0 or mark != ">":
                text = page[at : end if end >= 0 else None] if mark == "]]>" else ""
                return begin, end + len(mark) if end >= 0 else len(page), "", False, "", text
        return None


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, own features) of each flat text block, in page order."""
    page = page or ""
    out: list[tuple[str, list[float]]] = []
    open_, buffer, linked = [("", 0, False, False)], [], 0
    in_link, heading, at = False, False, 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            buffer.append(piece)
            if in_link:
                linked += len(piece.split())

    def flush() -> None:
        nonlocal linked
        if buffer:
            words = "".join(buffer).split()
            if words:
                _, beside, main, header = open_[-1]
                n = len(words)
                out.append((SPACE.join(words), [float(n), min(linked, n) / n, float(beside > 0), float(main), float(heading), float(header)]))
            buffer.clear()
        linked = 0

    markup = _Markup(page)
    while m := markup.find(at):
        begin, end, tag, closing, attributes, section = m
        text(page[at:begin])
        at = end
        if not tag:
            text(section)
            continue
        if tag in HIDDEN:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, max(markup.last + 1, at))
                at = end.end() if end else len(page)
            if tag in ("select", "button", "textarea"):
                buffer.append(SPACE)
            continue
        if tag == "a":
            in_link = not closing
        elif tag in ("br", "td", "th", "img", "input", "wbr"):
            buffer.append("" if tag == "wbr" else SPACE)
        elif tag in BLOCK:
            flush()
            in_link = False
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in CONTAINER:
                if not closing:
                    beside, main, header = _kind(tag, attributes)
                    _, up_beside, up_main, up_header = open_[-1]
                    if tag == "article" and beside == WEAK and not (up_beside or up_main):
                        beside = 0
                    if tag == "main" or main and not beside and up_beside == WEAK:
                        up_beside = 0
                    inner = up_main or main
                    open_.append((tag, max(up_beside, beside), inner, (up_header or header) and not inner))
                else:
                    for i in range(len(open_) - 1, 0, -1):
                        if open_[i][0] == tag:
                            del open_[i:]
                            break
    text(page[at:])
    flush()
    return out


def with_neighbours(found: list[tuple[str, list[float]]]) -> list[list[float]]:
    """FEATURES of each block: its own and the word count and link density of the blocks before and after it."""
    none = [0.0, 0.0]
    own = [f for _, f in found]
    rows = []
    for i, f in enumerate(own):
        before, after = own[i - 1][:2] if i else none, own[i + 1][:2] if i + 1 < len(own) else none
        rows.append([f[0], f[1], *before, *after, *f[2:]])
    return rows


#: Labelled blocks: a leading + marks text of the article, a leading - marks the rest; the mark is not part of the text.
TRAINING = [
    """<body><nav><ul><li><a>-Home</a><li><a>-World news</a><li><a>-Sport</a></ul></nav><div class="ad">-Buy one now and get another one free today only.</div><article><h1>+Rain ends a long dry summer</h1>
<p>+After nine weeks without a drop, rain fell on the valley on Sunday night and farmers came out to watch it.<p>+Short.<p>+The river rose by a hand's breadth before the morning, the water board said, which is <a>still</a> well below its usual level.<p>+More rain may follow.</article><footer>-All rights reserved by the publisher of this site.</footer>""",
    """<body><header><div>-The Daily Example</div><div><a>-Sign in</a></div></header><div class="cookie">-We use cookies to make this site better for you and for our partners. Read on to learn what that means.</div><main><h2>+On old maps</h2><p>+Maps of the coast were drawn by people who had never seen it, from what sailors told them in the harbour.
<blockquote>+He asked, and I answered as well as I could.</blockquote><ul><li>+the first map had no names<li>+the second had no hills</ul><div class="share"><a>-Send to a friend</a></div><p>+All of them are lost.</main><aside><h3>-Popular</h3><p>-This week our readers liked the story of the lighthouse keeper and his nine cats most of all.<p><a>-Ten roofs to see</a></aside><footer><p>-Contact us by mail at the address below, we answer within a week or so.</footer>""",
    """<body><div class="navbar"><a>-Start</a> <a>-About</a></div><div class="content"><h1>+How bread rises</h1><p>+Yeast eats sugar and gives off gas, and the gas is held by the dough as long as the dough is strong enough.<p>+That takes time.<div class="promo">-Get our book of forty recipes with free delivery until the end of the month.</div><p>+Warm rooms make it faster, cold ones give it a better taste.</div><div class="comments"><h3>-Two comments</h3><p>-I tried this last week and it was the best loaf that I have made in years, thank you so much.<p>-Nice.</div><div class="footer">-Imprint</div>""",
    """<body><div><a>-News</a> <a>-Weather</a> <a>-Traffic</a></div><div>-Example Times</div><div>+The bridge over the eastern arm will be closed for repairs from Monday until the first week of the next month, the town council has decided.</div><div>+Cars can use the older bridge in the north; walkers are taken across by a small ferry at the expense of the town, every day from six until dusk.</div><div>+There was one vote against the plan, by the owner of the inn beside the eastern bridge, who fears for his trade in the summer.</div><div><a>-Next story</a> <a>-Previous story</a></div><div>-Subscribe</div>""",
    """<body><form><p>-Write your name and your mail address here and press the button to get our letter every Friday morning.</form><header class="top"><p>-News from the hills since the year of the great flood</header><article><header><h1>+A walk in May</h1></header><p>+We set out early.<p>+By noon we had seen two deer, a fox and more birds than we could name, and had lost the path twice over.<aside>-Read also: the ten best boots for wet ground, tested by our own staff over a winter.</aside><p>+Then it snowed.</article><section id="comments"><p>-Where exactly is this path, I have lived here for thirty years and have never heard of it at all?</section><div role="alert">-Your session will end soon.</div>""",
    """<body><ul><li><a>-Front page</a><li><a>-Letters</a></ul><div class="notice">-This site keeps a record of what you read here so that it can show you more of the same; by going on you agree to this and to the terms that our partners have set out for such records.</div><div><p>+The mill at the lower weir has been turning again since Tuesday, after a pause of forty years, and the new miller says that she has orders for all the flour that it can grind until the autumn.<p>+She is glad.<p>+Her stones come from the same quarry as the old ones, which were broken up for a road when the mill was shut, and the wheel was made by two brothers in the next village.<p>+It took them a year.<p>+On Sundays the mill may be looked at, and there is bread from its own flour for those who come early enough, as not many did on the first of these Sundays, when it rained.</div><div id="discussion"><p>-My grandfather was the last miller there and he would have been so pleased to see the wheel go round again after all this time, I wish the new miller all the luck that there is in the world.<p>-Same here, and I hope that the bread is as good as they say, since there has been none worth eating in this town for as long as I can remember.</div><aside><p>-Readers who liked this story also liked the one about the baker who moved to the coast and the one about the flood that took away the lower bridge in the year of the long winter.</aside><footer><p>-The views in letters and comments are those of their writers and not of this paper, which takes no blame for them, nor for goods and services that are advertised on these pages by others.</footer>""",
    """<body><nav><p>-Here you find all that we have written about the town and its people in the last ten years, sorted by street and by the year in which it was first printed in our paper.</nav><table><tr><td>+Wheat was sown on less land than in any year since records began, since the price fell before the winter and the seed was dear, the growers' union told its members in a letter.</td></tr><tr><td>+Barley took its place.</td></tr><tr><td>+In the south, where the soil is light, growers turned to rye, which asks for little and is bought by the distillers whatever its quality may be.</td></tr></table><form><p>-Fill in the lines below and we shall send you our letter each Friday, with the prices of grain and of land in all the counties of the south, and nothing else, for as long as you wish.</form><div class="sidebar"><p>-Land for sale: four acres with a barn and a well, on the road to the coast, to be seen by those who write to the owner before the end of this month.</div><div><a>-Prices</a> <a>-Land</a> <a>-Weather</a> <a>-Machines</a> <a>-Seed</a> <a>-Tools</a> <a>-Letters</a> <a>-Old papers</a> <a>-Work</a> <a>-Help</a> <a>-For schools</a> <a>-For growers in the south</a> <a>-For growers in the north</a></div><div>-Terms</div>""",
    """<html class="cookie-consent"><body class="single-post has-sidebar comments-open"><nav><a>-Home</a> <a>-Gardens</a></nav><div class="page-with-widgets"><div class="content with-sidebar"><article class="post tags-trees related-posts-on"><h1>+Planting a pear</h1><p>+A pear wants a warm wall and a deep soil, and for the first two summers it wants a bucket of water every week, whatever the weather has been.<p>+Then leave it alone.</article><section id="comments"><article class="comment-body"><p>-Ours stood for six years without a single pear and then bore so many in one autumn that two branches broke off.</article></section></div><div class="sidebar"><p>-Our shop has young trees of twelve kinds, with free delivery to all towns on the coast from the first of November on.</div></div><footer>-Imprint</footer>""",
    """<body><nav><a>-Home</a> <a>-Rivers</a></nav><article><h2>+Sources</h2><p>+See <a>the map</a> of it.<p>+Written by <a>Ann Reed</a> in May.<ul><li>+<a>The upper weir</a> fell first.<li>+Then <a>the mill</a>.</ul><p>+Both were built again, the mill with <a>money from the county</a> and the weir by the people of the village with their own hands over two summers.<p>+<a>Plans</a> are kept.</article><aside><p>-See <a>our guide</a> to weirs.</aside><footer>-Write to <a>the editor</a> of it.</footer>""",
    """<body><div class="menu"><a>-Start</a></div><main><p>+By <a>Jo Hill</a>.<p>+The ferry stopped on Monday, and nobody knows when it will run again, since the new engine lies on the quay at <a>Port Sand</a>.<p>+More on <a>the engine</a> here.<p>+It is blue.</main><div class="related"><p>-More on <a>ferries</a> here.</div><footer><p>-By <a>The Coast</a>.</footer>""",
]


#: Pages of bare div elements, and as many with telling ones, that are added to TRAINING.
SAMPLE_PAGES = 80
_SYLLABLES = "ba den fo gri ka lem mor nu pel qua ri sto tan ve wil zo".split()


def sample_page(seed: int, marked: bool) -> str:
    """A labelled page: links, short lines, paragraphs long and short, then links, short lines and prose of others.

    On a page that is not marked, only word counts, link densities and those of the neighbours tell its article; there
    is no prose of others on it. A marked page has its parts in elements and names that tell them.
    """
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))
    line = lambda mark, low, high, tag="div": f"<{tag}>{mark}{words(rng.randint(low, high))}</{tag}>"
    links = lambda n: "".join(f"<div><a>-{words(rng.randint(1, 9))}</a></div>" for _ in range(n))
    around = lambda inner, *ways: rng.choice(ways) % inner if marked else inner
    ads = ('<div class="ad">%s</div>', "<aside>%s</aside>", '<div class="promo">%s</div>', '<div role="alert">%s</div>', '<div class="cookie">%s</div>')
    top = around(links(rng.randint(2, 8)), "<nav>%s</nav>", '<div class="menu">%s</div>')
    top += around(line("-", 1, 8), "<header>%s</header>", *ads) + (around(line("-", 1, 60), *ads) if marked else links(rng.randint(0, 2)))
    article = [line("+", 1, 12, "h1")] if marked else []
    article.append(line("+", 1 if marked else 25, 90))
    for _ in range(rng.randint(0 if marked else 3, 12)):
        kind = rng.random()
        if kind < 0.12:
            article.append(around(links(1), *ads))
        elif kind < 0.3:
            article.append(f"<div>+{words(rng.randint(1 if marked else 20, 60))} <a>{words(2)}</a> {words(5)}</div>")
        else:
            article.append(line("+", 1, 9) if kind < 0.55 else line("+", 20, 90))
    if not marked:
        article.append(line("+", 20, 90))
    below = links(rng.randint(1, 4)) + line("-", 2, 9) + links(rng.randint(1, 6)) + line("-", 2, 9)
    if marked:
        below = around(line("-", 1, 60) + line("-", 1, 60), "<section id='comments'>%s</section>", *ads) + rng.choice(["", around(below, "<div class='related'>%s</div>", "<aside>%s</aside>")])
        below += around(line("-", 1, 40), "<footer>%s</footer>", '<div class="footer">%s</div>')
    return "<body>" + top + around("".join(article), "<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>') + below


def labelled(pages: list[str]) -> list[tuple[list[float], float]]:
    """Features and label (1 for the article) of each block of labelled pages."""
    rows = []
    for page in pages:
        found = blocks(page)
        rows += [(f, float(t.startswith("+"))) for (t, _), f in zip(found, with_neighbours(found), strict=True)]
    return rows


def training_rows() -> list[tuple[list[float], float]]:
    return labelled([*TRAINING, *[sample_page(i, m) for i in range(SAMPLE_PAGES) for m in (False, True)]])


def train(spark: SparkSession, depth: int = 8) -> tuple:
    """The decision tree as nested (feature, threshold, left, right) with 0.0 or 1.0 at its leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    table = spark.createDataFrame([(Vectors.dense(f), y) for f, y in training_rows()], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(table.coalesce(1))

    def plain(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        split = node.split()
        return split.featureIndex(), float(split.threshold()), plain(node.leftChild()), plain(node.rightChild())

    return plain(model._java_obj.rootNode())


def predict(tree, features: list[float]) -> bool:
    while isinstance(tree, tuple):
        at, threshold, left, right = tree
        tree = left if features[at] <= threshold else right
    return tree > 0.5


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return "\n\n".join(t for (t, _), f in zip(found, with_neighbours(found), strict=True) if predict(tree, f))


def extract_text(pages: DataFrame, html_col: str = "html", tree=None) -> DataFrame:
    """pages without html_col, and text and n_chars (its code points).

    A block is text between block elements, with character references decoded and blanks turned into one space; those
    that the tree takes for the article are joined by two newlines in page order. Null and empty pages, and pages
    without an article, have an empty text. Pages are read whole. Each row is worked on alone, so repeated rows give
    equal rows; an empty table gives no rows. Columns of pages named text or n_chars are replaced.
    """
    tree = train(pages.sparkSession) if tree is None else tree
    keep = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]

    def run(batches):
        import pyarrow as pa

        for b in (part.slice(lo, 500) for part in batches for lo in range(0, part.num_rows, 500)):
            texts = [main_text(p, tree) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, "text", "n_chars"])

    schema = StructType([*pages.select(*keep).schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*keep, html_col).mapInArrow(run, schema)
