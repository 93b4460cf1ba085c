"""Main text of web pages by a decision tree over flat text blocks.

A page is read once from left to right, by HTML's rules for tags, attributes and comments, into flat blocks of
text. Each has its number of words and link density, those of its neighbours, and marks of where it stands:
in an element for navigation and the like, in an element whose class or id names such a thing (how clearly,
and how much of the page's text it holds) or names content, in an article (how much of the text that one holds, and the
largest one of the page), how much what it stands in holds, a heading, an item of a list. A decision tree, trained on the small labelled table of
this module, tells content from the rest. An article is no rule by itself: where teasers stand in articles, the story is outside.

Defined cases: null or empty html gives an empty text; tags that are never closed end with the element
around them or the page, a link that is never closed with its block; script, style and the like hold no text, nor do
elements that are hidden by attribute or by their own style; a page without blocks of content gives
an empty text; pages of any length are read whole, one at a time; blocks that repeat stay, and so do
repeated rows; an empty table gives an empty result; of further columns, those asked for are passed on, and
``text`` and ``n_chars`` are this operator's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# fixed values of HTML: names of elements
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = {"template", "noscript", "svg", "math", "object", "canvas", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "ruby", "rt", "rp"}
CONTAINERS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset"}
#: Open elements that end where one of this name begins.
CLOSES = {"li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
#: Words of class, id and role that name furniture of a page, and words that say nothing either way.
NAMED = re.compile("ads?|advert|advertisement|adverts|adsense|sponsor|sponsored|promo|promotion|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side|widgets?|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|masthead|header|footer|copyright|legal|comments?|disqus|replies|reply|share|sharing|social|related|recommended|recommendations|tags?|search|skip|complementary|contentinfo")
NEUTRAL = {"site", "page", "list", "box", "container", "wrapper", "wrap", "block", "area", "section", "top", "bottom", "left", "right", "inner", "outer", "body", "item", "items", "slot", "posts", "links", "buttons", "bar", "text", "main", "the", "global", "js"}

# a quote opens a value only behind "="; elsewhere in a tag it is a character like any other
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'>][^\s>]*|[^>])*+)>|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""", re.I)
VALUE = re.compile(r"""=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""")
UNSEEN = re.compile(r"(?<![^\s/])hidden(?=[\s=/]|$)", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
#: Elements that are parts of a text; what holds it is the next element around them.
PARTS = {"p", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "tbody", "thead", "tr", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", *INLINE}
#: Words of class and id that name what a page is about.
TOLD = re.compile("content|article|post|story|entry|main|text|body|prose|page")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w\S*")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "share", "told", "article", "outside", "holder", "heading", "item")


def named(said: str) -> float:
    """How clearly class, id or role name furniture: of a name's telling words, the share that do; the most of all names."""
    most = 0.0
    for name in said.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w and w not in NEUTRAL]
        if words:
            most = max(most, sum(NAMED.fullmatch(w) is not None for w in words) / len(words))
    return most


def told(said: str) -> bool:
    """Whether class or id names content, and nothing else that tells."""
    words = [w for name in said.lower().split() for w in re.split(r"[_-]+", name) if w]
    return any(TOLD.fullmatch(w) for w in words) and not any(NAMED.fullmatch(w) for w in words)


def unseen(attributes: str, style: str) -> bool:
    """Whether an element is hidden by its own attributes."""
    return NO_DISPLAY.search(style) is not None or ("hidden" in attributes.lower() and UNSEEN.search(VALUE.sub("=", attributes)) is not None)


class Open:
    """An element that is open: its name and marks, and the words in it once it has ended."""

    __slots__ = ("name", "container", "named", "told", "article", "hidden", "start", "words")

    def __init__(self, name: str, container: bool, named: float, told: bool, article: bool, hidden: bool, start: int):
        self.name, self.container, self.named, self.told, self.article, self.hidden, self.start, self.words = name, container, named, told, article, hidden, start, 0


class Blocks:
    """The flat blocks of one page: (text, words, linked words, container, its outermost article, heading, item, its most clearly named element, told, what holds it, from the innermost on)."""

    def __init__(self, html: str):
        self.found: list[tuple] = []
        self.parts: list[str] = []
        self.linked = self.words = self.anchors = self.hidden = 0
        self.open: list[Open] = []
        self.articles: list[Open] = []
        self.kind = ""
        self.next_anchor: re.Match | None = None
        self.read(html)

    def flush(self) -> None:
        text = SPACE.sub(" ", unescape("".join(self.parts))).strip()
        if text:
            words = max(1, len(WORD.findall(text)))
            named_by = max((x for x in self.open if x.named), key=lambda x: x.named, default=None)
            article = next((x for x in self.open if x.article), None)
            self.found.append((text, words, self.linked, any(x.container for x in self.open), article, self.kind[:1] == "h" and self.kind[1:].isdigit(), self.kind in ("li", "option", "dt"), named_by, any(x.told for x in self.open), [x for x in reversed(self.open) if x.name not in PARTS]))
            self.words += words
        self.parts, self.linked = [], 0

    def end(self, at: int) -> None:
        """The open elements from place ``at`` on end here."""
        for x in self.open[at:]:
            x.words = self.words - x.start
            self.hidden -= x.hidden
        del self.open[at:]

    def read(self, html: str) -> None:
        at = 0
        while (m := TOKEN.search(html, at)) is not None:
            self.text(html[at : m.start()])
            at = m.end()
            if m[2]:
                at = self.tag(m[2].lower(), bool(m[1]), m[3], html, at)
        self.text(html[at:])
        self.flush()
        self.end(0)

    def text(self, raw: str) -> None:
        if raw and not self.hidden:
            self.parts.append(raw)
            if self.anchors:
                self.linked += len(WORD.findall(raw))

    def tag(self, name: str, closing: bool, attributes: str, html: str, at: int) -> int:
        if name in RAW and not closing:
            self.parts.append(" ")
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            return end.end() if end else len(html)
        if name == "a":
            self.anchors = 0 if closing else 1
            if self.anchors:
                # one that is not closed before the next begins, or at all, ends with its block
                self.anchors = 1 if self.closed(html, at) else 2
            return at
        if name in INLINE:
            if name == "br":
                self.parts.append(" ")
            elif closing and self.open and self.open[-1].name == name:
                self.end(len(self.open) - 1)
            elif not closing and name not in VOID and unseen(attributes, self.said(attributes)[1]):
                self.hide(name)
            return at
        if name in HIDDEN:
            self.parts.append(" ")
        else:
            self.flush()
            self.kind = "" if closing else name
            if self.anchors == 2:
                self.anchors = 0
        if name in VOID:
            return at
        if closing:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].name == name:
                    self.end(i)
                    self.anchors = 0
                    break
            return at
        if name in ("svg", "math") and attributes.endswith("/"):
            return at
        while self.open and (self.open[-1].name in CLOSES.get(name, ()) or (self.open[-1].name == "p" and name not in HIDDEN)):
            self.end(len(self.open) - 1)
        said, style = self.said(attributes)
        article = name in ("article", "main") or said.strip().lower() in ("article", "main")
        inside = any(x.article for x in self.open)
        hidden = name in HIDDEN or unseen(attributes, style)
        self.hidden += hidden
        self.open.append(Open(name, name in CONTAINERS and not (name == "header" and inside), named(said) if said else 0.0, bool(said) and told(said), article, hidden, self.words))
        if article and not inside:
            self.articles.append(self.open[-1])
        return at

    def closed(self, html: str, at: int) -> bool:
        """Whether the next tag of a link is one that closes; it is looked for once."""
        if self.next_anchor is None or self.next_anchor.start() < at:
            self.next_anchor = ANCHOR.search(html, at) or self.none(html)
        return self.next_anchor[1] == "/"

    def none(self, html: str) -> re.Match:
        """As if a link began at the end of the page."""
        return re.compile("()$").search(html, len(html))  # type: ignore[return-value]

    def said(self, attributes: str) -> tuple[str, str]:
        """Class, id and role, and the style."""
        if "=" not in attributes:
            return "", ""
        found = [(k.lower(), v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)]
        return " ".join(v for k, v in found if k != "style"), ";".join(v for k, v in found if k == "style")

    def hide(self, name: str) -> None:
        self.hidden += 1
        self.open.append(Open(name, False, 0.0, False, False, True, self.words))


def features(page: Blocks) -> list[list[float]]:
    """A row of FEATURES for each block; at either end of the page a block is its own neighbour."""
    found = page.found
    largest = max((x.words for x in page.articles), default=0) / max(1, page.words)
    own = [(b[1], min(1.0, b[2] / b[1])) for b in found]
    around = [*own[:1], *own, *own[-1:]]
    rows = []
    for i, (b, (words, links)) in enumerate(zip(found, own, strict=True)):
        furniture = (1.0, 0.0) if b[3] else (b[7].named, b[7].words / page.words) if b[7] else (0.0, 0.0)
        article, outside = (b[4].words / page.words, 0.0) if b[4] else (0.0, largest)
        # what a block shares with others: the next element around it that has more words than it
        holder = max(article, next((x.words / page.words for x in b[9] if x.words > words), 1.0))
        rows.append([words, links, *around[i], *around[i + 2], *furniture, float(b[8]), article, outside, holder, float(b[5]), float(b[6])])
    return rows


# The labelled table: pages, and which of their blocks are content.
LABELLED = (
    ("<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul></nav><div class='ad'>Buy two lamps and get the third one free.</div><article><h1>Rivers of the north</h1><p>Rivers carry sand and stones down to the plain, and where they slow they drop them.</p><p>So it goes.</p></article><footer>(c) Example. All rights reserved.</footer>", "000011 1 0"),
    ("<header><a href=/>Site</a> A daily paper for all of us</header><article><h2>Bread</h2><p>Mix flour, water and salt, and leave the dough in a warm place until it has grown.</p><p>Bake.</p><p>Read <a href=/x>the long recipe for it here</a></p></article><aside>Most read this week in our kitchen</aside><footer>Imprint</footer>", "01111 0 0"),
    ("<div id=sidebar><p>About the author of this site, who has written here for many years and lives by the sea.</p></div><main><p>The tower was built on older walls that nobody had cared to draw before it fell.</p><ul><li>Height in feet</li><li>Year of building</li></ul></main><div class='cookie-notice'>We use cookies to make this page work better for you and for our partners. By going on you agree to that.</div>", "0 1 11 0"),
    ("<main><h1>Report</h1><p>Short note.</p><form><label>Your mail address</label><p>Sign up for letters that we send every week to our friends.</p></form></main><section class=comments><p>I liked this very much and have sent it to all of my friends at home, thank you.</p></section>", "11 00 0"),
    ("<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a> <a href=4>Four</a></div><div><p>Long before the road was laid, people walked along the ridge to reach the market on the other side of it.</p><p>They came back with salt, and with news from places that they would never see for themselves in their lives.</p></div><div><a href=9>Terms of use</a> <a href=8>Privacy</a></div>", "0 11 0"),
    ("<div><a href=1>Start</a></div><div><h1>What the moss tells</h1><p>Moss grows where the air is clean and the stone is wet, which is why those who study it carry a lens and patience.</p><p>Yes.</p><p>It has no roots that reach the ground below, and so it drinks what falls on it, day after day, for many years.</p></div><div><a href=2>Next</a></div>", "0 1111 0"),
    ("<div>Menu</div><div><a href=1>Shop</a></div><div><a href=2>Cart of goods</a></div><p>The old clock has run for two hundred years with no more care than a drop of oil each spring, says its keeper.</p><p>He shows us how.</p><p>Each wheel was cut by hand, and no two of them are quite alike, though all of them turn as they should.</p><div><a href=3>Back to top</a></div>", "000 111 0"),
    ("<article><p>Here.</p><p>There <a href=1>was</a> one.</p><h3>Then</h3><ul><li><a href=2>A linked thing of note</a></li><li>Plain</li></ul><blockquote>Nothing was said.</blockquote></article><div class=related><p>More on this subject that you may wish to read after this page, as many others did.</p></div>", "111111 0"),
    ("<article><p>In the yard stood a pump that gave cold water all summer long, even in the driest years.</p><div class='advert'>Pumps from ten coins, only this week at your dealer in town.</div><p>It broke.</p><aside>See also the piece on wells</aside><div class='share'>Share this page with those you know</div></article>", "10 1 00"),
    ("<article><p><a href=1>Go on</a></p><p><a href=2>Or stay</a></p></article><p>Terms apply.</p>", "11 0"),
    ("<article><p>Alone.</p></article>", "1"),
    ("<p>The ferry left at noon with nine people on board, two of whom had not paid for the crossing.</p><p>Nobody minded.</p>", "11"),
    ("<div>Words of the day were few, and those few were kept by the clerk in a book that is lost to us now.</div>", "1"),
    ("<div>Log in</div><div>The second harvest was better than the first, as the rain had come in time and stayed for long.</div><div>Help</div>", "0 1 0"),
    ("<p>Welcome to the site of all who like to walk in the hills.</p><article><p>Only this.</p><p><a href=4>Map</a></p></article><p>Written by the staff of the site, who may be reached by post or by wire at any hour of the day.</p>", "0 11 0"),
    # pages that end with what they are about
    ("<article><h1>Wool</h1><p>Sheep were shorn in June, and the wool was washed in the brook before it went to market.</p><p>It was sold by weight, wet or dry, and so the buyers brought their own scales to the yard.</p></article>", "111"),
    ("<nav><a href=1>Start</a></nav><main><p>The path up to the chapel has three hundred steps, and each of them bears a name.</p><p>Some names are worn away.</p><p>Those who climb it on foot are given bread and wine at the top, as it has been for ages.</p></main>", "0 111"),
    ("<nav><a href=1>Start</a> <a href=2>About</a></nav><article><h2>Ice</h2><p>Ice was cut on the lake in blocks as long as a man.</p><ul><li>Saws</li><li>Hooks and long poles</li></ul></article>", "0 1111"),
    ("<div><a href=1>Start</a></div><div><a href=2>Map of the site</a></div><p>A hundred years ago the last wolf was seen near the village, and the place still has its name from it.</p><p>Now they are back, and not all who live here are glad of it, though most have never seen one.</p>", "00 11"),
    ("<article><p>One.</p><p>Two of them went on.</p><p>All the others stayed behind at the inn.</p></article>", "111"),
    ("<p>Peat burns slowly and smells of earth.</p><p>It is cut in spring, stacked in rows, and carried home when it is dry enough to be light.</p>", "11"),
    ("<main><section><h2>Rope</h2>Rope was made on long walks under roofs, by men who went backwards all day.</section><section>Each rope had one thread of colour in it, so that thieves could be told from owners.</section></main>", "111"),
    ("<div class=ad>Cheap flights to all places under the sun</div><article><p>Bees find home by the light of the sky.</p><p><a href=1>Where they go</a> nobody had asked before.</p><p>They dance to tell the others.</p></article>", "0 111"),
    # class names that mislead: parts of a name, and a name on what holds the page
    ("<nav><a href=/>Home</a></nav><article><div class='tag-line'>A short line that says what is to come in it.</div><p>The bridge was closed for repair in spring, and the ferry took its place until the autumn came.</p><div class='search-results-study'><p>Of forty who were asked, nine had found what they were looking for on the first day.</p></div></article><footer>Imprint</footer>", "0 111 0"),
    ("<div class='page side-story'><h1>Salt</h1><p>Salt was carried over the pass on mules, forty to a train, each with two sacks and a bell.</p><div class=share><a href=1>Send</a> this to a friend</div></div>", "11 0"),
    ("<body class=search><div id=header><a href=/>Daily</a></div><h2>Grain</h2><p>Grain prices fell again this week, as ships that had been kept in port by ice came in at last.</p><p>Rye held.</p><p>Traders expect more of the same until the thaw is over and the roads to the east are open.</p><div id=footer>All prices without warranty of any kind</div></body>", "0 1111 0"),
    ("<article><h1>Glass</h1><section class='header-history'><p>The first sheets were blown as cylinders, cut open along the side and laid flat in the oven.</p></section><div class='legal-background'><p>A law of that year forbade the trade to all who were not of the guild of the town.</p></div><div class=comments><p>My grandfather worked there and told us the same story, every winter, by the stove at night.</p></div></article>", "111 0"),
    ("<main class=sidebar-left><p>Two lines of track led up to the quarry, and one of them is still in use for visitors today.</p><div class=sidebar><p>Opening hours: from nine to five on all days but Monday, and not at all in winter.</p></div></main>", "1 0"),
    ("<div class=cookie-banner><p>This site stores small files on your device so that it can remember what you have chosen before.</p></div><div class=story><p>The mill stands where the stream leaves the wood, and its wheel has been still for fifty years.</p><p>Moss covers it.</p></div><div class=comment-list><p>We were there last summer with the children and they did not want to leave the place again.</p></div>", "0 11 0"),
    # pages without marks, where only the neighbours tell
    ("<div><a href=1>News</a></div><div>Regional</div><div><a href=2>Sport</a></div><div><a href=3>Weather report</a></div><div>The council has decided to plant two hundred trees along the road to the station before winter comes.</div><div>Limes, mostly.</div><div>They will be paid for by those who drive there, at a rate that is to be set in spring.</div><div><a href=4>More news</a></div><div>Service</div><div><a href=5>Contact</a></div>", "0000 111 000"),
    ("<div>Sections</div><div><a href=1>Letters to us</a></div><p>A letter took nine days to reach the island, if the sea was calm and the master of the boat was sober.</p><p>It often was not.</p><p>So people wrote twice, and the second letter told what had happened since the first one had been sent.</p><div><a href=2>Earlier pieces</a></div><div>Follow us</div><div><a href=3>By mail</a></div>", "00 111 000"),
    ("<table><tr><td><a href=1>A</a><td>|<td><a href=2>B</a><tr><td>All that is known of the painter stands in one bill for blue and gold, and in the parish book.<tr><td>He was paid late.<tr><td><a href=3>Up</a><td>-<td><a href=4>Down</a></table>", "000 11 000"),
    ("<div><a href=1>Home page</a></div><div>You are here</div><div><a href=2>Archive</a></div><div>When the lamp was lit on the tower, the fishermen on the bank could tell the hour by its turning.</div><div>That is over.</div><div><a href=7>See the list of lamps</a> that were given up in those years, and of the ones that were kept, with the names of all keepers</div><div><a href=3>Back</a></div><div>Printed version</div><div><a href=4>Imprint</a></div>", "000 111 000"),
    ("<ul><li><a href=1>First</a><li><a href=2>Second</a><li>Third</ul><h1>On the use of chalk</h1><p>Chalk is soft enough to write with and hard enough to build with, which is why the hills are full of holes.</p><ul><li>Writing</li><li>Walls of <a href=3>houses</a></li></ul><p>Both uses have been given up since, and the holes are now homes for bats, which nobody may disturb.</p><ul><li><a href=4>Next</a><li>Top</ul>", "000 11111 00"),
    ("<p><a href=1>Today</a> <a href=2>Tomorrow</a></p><p>Rain.</p><p>In the north it will rain all day, and on the coast the wind will be strong enough to bend the young trees.</p><p>Mild.</p><p>In the south the sun comes through at noon, and by the evening it will be warm enough to sit outside.</p><p>Copyright by the weather office</p><p><a href=3>Terms</a> <a href=4>Help</a></p>", "0 1111 00"),
    # the story outside of articles, which hold teasers
    ("<nav><a href=/>Home</a></nav><div id=content><h1>The dry lake</h1><p>Where the lake was, the ground is white with salt, and cars drive over it to the far shore.</p><p>It may come back.</p><p>In wet years a hand of water stands there for a month, and birds come from far away.</p></div><section><h3>More stories</h3><article><a href=1>A mill is for sale</a></article><article><a href=2>The last train</a><p>It ran at night.</p></article></section>", "0 1111 0 0 00"),
    ("<div class=story><p>The post came by boat on two days of the week, and on those days nobody went out to fish.</p><p>They read it aloud.</p></div><div class=teasers><article><h4><a href=1>How nets are made</a></h4></article><article><h4><a href=2>Storm of the year</a></h4></article><article><h4><a href=3>Lamps</a></h4></article></div>", "11 000"),
    ("<div><a href=/>Start</a></div><p>He kept a book of all the ships that passed, with their flags and what the sea was like that hour.</p><p>The book has nine hundred pages, and the last line in it is of the day before he died.</p><article><p><a href=1>Read of other keepers</a></p></article><article><p><a href=2>Towers to see</a></p></article>", "0 11 0 0"),
    ("<main><article><h2><a href=1>First of May</a></h2><p>The tree was set up at dawn, with ribbons, and by noon the whole village had danced round it.</p></article><article><h2><a href=2>Hay</a></h2><p>This year the hay was in before the rain, which has not been so since the bridge was built.</p></article></main><aside>Follow us</aside>", "11 11 0"),
    ("<nav><a href=/>Home</a></nav><div class=entry-content><h1>A bell for the school</h1><p>The old bell had a crack, and when it was rung in frost it fell silent for the rest of the winter.</p><p>It hangs in the hall.</p></div><article class=next><h4><a href=5>A clock for the church, given by the guild</a></h4><p>Read what it cost to have it made.</p></article>", "0 111 00"),
    ("<div id=main><h2>Moving house</h2><p>All that they owned went on one cart, with the hens in a basket on top of it.</p><p>The dog walked.</p><p>By night they were there.</p></div><article><h3><a href=1>Carts and who built them</a></h3><p>From the yard to the fair, a look at wheels.</p></article><article><h3><a href=2>Hens</a></h3></article>", "1111 00 0"),
    ("<article><h1>Vinegar</h1><p>Wine left open turns to vinegar by itself, and good vinegar takes a year in a barrel that is never quite full.</p><p>Smell it.</p><p>It is ready when it bites.</p><h2>Uses</h2><p>Few know all of them.</p></article><div>Recipe of the day</div>", "111111 0"),
    ("<ol class=breadcrumb><li><a href=1>Start</a></li><li>Yard</li></ol><div class=post><h1>Oiling a gate</h1><p>A gate that sings wants oil, and a gate that hangs wants a longer pin and a friend to hold it.</p><p>Then paint.</p></div><div class=tags>Iron, wood</div>", "00 111 0"),
    ("<main><h1>Lots</h1><div id=notices-of-old><p>Notices were read out after church, first those of the king and then those of lost sheep.</p><p>Some wept.</p><p>Some laughed, and some went home to look in the shed.</p></div></main><div class=notice>The site is closed for works on Sunday night.</div>", "1111 0"),
    ("<nav><a href=/>Home</a></nav><div id=story><h1>Slate</h1><p>Slate splits along the grain, and a good hand can make eight roofing plates of a block as thick as a thumb.</p><p>The dust harms the lungs.</p></div><article><h2><a href=1>Old roofs</a></h2></article><article><h2><a href=2>Copper</a></h2></article><article><h2><a href=3>Thatch and straw</a></h2></article>", "0 111 000"),
    # adverts and notices in an article, with the name on the paragraph
    ("<article><h1>Wells</h1><p>The well in the yard is forty feet deep and has never been dry in the time of those who live here.</p><p class=advert>Pumps and pipes at half the price, this week only, at your dealer in town.</p><p>Water is drawn by hand.</p><p id=cookie-notice>This page stores small files on your device to count those who read it.</p></article>", "11 0 1 0"),
    ("<article><p class=sponsored>Sleep better on a bed from our partner, now with free transport to your door.</p><p>Bats leave the church at dusk, one after the other, and the sexton counts them from the wall.</p><p>Last night there were ninety.</p><p class=promo>Take our letter for three months and pay for two of them.</p></article>", "0 11 0"),
    ("<article><p class=lead>Of the nine mills on the brook one still turns, and it grinds for those who bring their own corn.</p><p class='text first'>The miller is eighty.</p><p class=notice>You have read four of five free pieces this month.</p><p id=p4>His son has gone to the city and will not come back, as he says without being asked.</p></article>", "11 0 1"),
    ("<div class=ads>Act now</div><article><h2>Straw</h2><p>Straw was cut short for the horses and left long for the roofs, and the rest was bedding.</p><p class=advert>Mow for less.</p><p>Roofs lasted thirty years.</p><p class=banner>Last days of sale</p></article><div class=cookie-bar>We use cookies</div>", "0 11 0 1 0 0"),
    ("<main><div class=share>Share it</div><p>Two bells hang in the tower, and the smaller is the older one by two hundred years.</p><p id=newsletter-note>Get our letter.</p><p>It cracked.</p><div class=related>More like this</div><p>A ring of iron holds it, put on by a smith whose name is cast in the other.</p></main>", "0 1 0 1 0 1"),
    ("<div><a href=1>Overview</a></div><div>Timber came down the river on rafts that were as long as a street, with a hut for the crew and a fire on sand.</div><div>At the bend they were taken apart and sold by the log to the yards on both banks of it.</div><section class=comments><h3>Replies</h3><p>My grandfather was one of the crew and told us of the fire on the sand.</p></section>", "0 11 00"),
    ("<p><a href=1>Back to list</a></p><p>On the last day of the fair the cattle that had not been sold were given away for the price of the rope, or so it is told.</p><p>Nobody has seen it.</p><p><a href=2>Forward</a></p><div class='reader-comments'><h2>What you say</h2><p>It is true, my aunt was there.</p></div>", "0 11 0 00"),
    # names of furniture on what the page is about
    ("<nav><a href=/>Home</a></nav><article><h1>What the court said</h1><section id=legal><p>The judges held that the path had been open to all for a hundred years and so must stay open.</p><p>The owner may put up a gate.</p><p>It must not be locked.</p></section></article><footer>Imprint</footer>", "0 1 111 0"),
    ("<article><section class=promotion><h2>Moving up</h2><p>The club goes up to the second league after a season in which it lost only two games at home.</p><p>Nobody had thought it could be done with so young a team, and least of all its own trainer.</p><p>They sang all night.</p></section></article><div class=legal>All prices with tax</div>", "1111 0"),
    ("<main><div class=comments-study><h1>How people write under news</h1><p>We read nine thousand of the lines that readers leave under reports of fires, floods and games.</p><p>Most were kind.</p></div></main><div class=comments><p>This is not what I have seen there at all, but I may read the wrong pages.</p></div>", "111 0"),
    ("<article><div class=header><h1>The toll house</h1></div><div class=search><p>The search for the deed took two years and led through five archives in three towns.</p><p>It was found in a drawer.</p></div><div class=share>Send to a friend</div><div class=tags><a href=1>Houses</a> <a href=2>Roads</a></div></article>", "1 11 0 0"),
    # links that are never closed
    ("<article><p>The list is <a href=1>kept here<p>All names on it are those of men, though women did half of the work and most of the counting.<p>Few know that.</article><div><a href=2>Up</a></div>", "111 0"),
    ("<article><h1><a href=/self>Title of it</a></h1><div>A walk.</div></article><div><a href=/b>Older</a></div><div>Made with care by a small team in the north, with thanks to all who wrote to us over the years.</div>", "11 00"),
)


def labelled(pages: tuple[tuple[str, str], ...] = LABELLED) -> tuple[list[list[float]], list[int]]:
    rows, labels = [], []
    for html, marks in pages:
        page = Blocks(html)
        own = [int(c) for c in marks if c != " "]
        if len(own) != len(page.found):
            raise ValueError(f"{len(own)} labels for {len(page.found)} blocks of {html[:60]!r}")
        rows += features(page)
        labels += own
    return rows, labels


def train(rows: list[list[float]], labels: list[int], depth: int = 8, least: int = 2) -> tuple | float:
    """A binary tree by Gini impurity, with ``least`` rows in a leaf: (feature, threshold, at most, above) or the share of content."""
    share = sum(labels) / len(labels)
    if depth == 0 or share in (0.0, 1.0):
        return share

    def impurity(part: list[int]) -> float:
        return 2 * sum(part) * (len(part) - sum(part)) / len(part)

    best = None
    for j in range(len(rows[0])):
        values = sorted({r[j] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            below = [y for r, y in zip(rows, labels, strict=True) if r[j] <= cut]
            above = [y for r, y in zip(rows, labels, strict=True) if r[j] > cut]
            if min(len(below), len(above)) < least:
                continue
            if best is None or impurity(below) + impurity(above) < best[0] - 1e-12:
                best = (impurity(below) + impurity(above), j, cut)
    if best is None:
        return share
    _, j, cut = best
    parts = [[(r, y) for r, y in zip(rows, labels, strict=True) if (r[j] <= cut) == side] for side in (True, False)]
    return (j, cut, *(train([r for r, _ in p], [y for _, y in p], depth - 1, least) for p in parts))


def score(tree: tuple | float, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(html: str | None, tree: tuple | float) -> str:
    """The blocks of content, joined by line ends."""
    if not html:
        return ""
    page = Blocks(html)
    return "\n".join(b[0] for b, row in zip(page.found, features(page), strict=True) if score(tree, row) >= 0.5)


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``columns``, the main text of each page and its number of code points."""
    tree = train(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h, tree) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*columns, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(*columns, html).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", text string, n_chars bigint")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
