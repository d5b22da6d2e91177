"""Main text of web pages by differencing each page with the nearest URL of its host.

A page becomes lines (blocks of text) in page order. Pages of a host are put in the order of their URL paths; each is
paired with the neighbour whose path shares the longest prefix. The two line sequences are aligned by their longest common
subsequence: lines in it belong to the site, not to the page, and go. Markup then corrects what one pairing cannot see: lines
in menus, footers, adverts, forms and the like go although the neighbour lacks them, and lines inside <article> or
<main> stay although a copy of the article stands at the next URL. Where no line is shared, markup alone decides.

Only digests of lines meet in the pairing; a page's markup is shuffled once, to meet its neighbour's digests.
"""
import hashlib
import html as entities
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.llm.common import row_key
from kinsift.llm.url_filters import url_host, url_path

#: Names that HTML gives to blocks, to text that is never shown or never prose, and to frames of a page.
BLOCKS = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul center".split())
RAW = set("script style textarea title noscript template iframe object svg math select option button canvas audio video".split())
FRAMES = set("nav footer aside form menu dialog".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id that sites use for what surrounds an article.
MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
            "notices alert sidebar comment comments commentlist disqus respond menu nav navbar navigation breadcrumb breadcrumbs footer "
            "masthead share sharing social related recommended newsletter subscribe subscription popup modal overlay widget toolbar "
            "pagination pager login signup search skip copyright".split())
#: Words that turn such a word into its opposite: no-sidebar, ad-free.
NEGATIONS = set("no not non without with has have hide hidden is free off disable disabled".split())
#: Words that only say what holds such a thing or where it is: ad-slot, share-buttons, related-posts.
HOLDERS = set("area bar block blocks box button buttons container content form group icons inner item items left link links list panel posts right "
              "section slot top bottom unit wrap wrapper".split())
#: Share of a page's words beyond which an element is the page itself, whatever its class says.
WHOLE = 0.9
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_JOINTS = re.compile(r"[^a-z]+")


def _is_marked(name):
    """Whether one class or id names a frame: as a whole (ad, sidebar), or a compound by its last word (site-footer, siteFooter) or
    with holders after it (ad-slot), unless a word of it negates (no-sidebar). Before other words it says nothing: social-science."""
    if name.lower() in MARKS:
        return True
    parts = [p for p in _JOINTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    return bool(parts) and not NEGATIONS.intersection(parts) and parts[-1] in MARKS


def _frame(tag, attributes, in_article):
    """2 if the element is a frame by its tag, role or invisibility, 1 if by its class, its id or as a form, else 0."""
    if tag != "form" and (tag in FRAMES or (tag == "header" and not in_article)):
        return 2
    if "=" not in attributes and "hidden" not in attributes:
        return int(tag == "form")
    values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if values.get("role", "").lower() in ROLES or values.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|/|=|$)", attributes, re.I):
        return 2
    if "display:none" in values.get("style", "").replace(" ", "").lower():
        return 2
    if tag in ("html", "body", "article", "main"):
        return 0
    return int(tag == "form" or any(map(_is_marked, f"{values.get('class', '')} {values.get('id', '')}".split())))


def lines(page):
    """[(text, framed, in article)] of a page in page order. Broken markup is read as far as it makes sense: an open tag
    at the end closes there, a closing tag without its opening one is passed over.

    An element that only its class or id marks, or a form, frames nothing if it contains the page's article (the outermost <article>
    or <main> with the most words) or, on a page without one, more than WHOLE of the words outside other frames."""
    out, words, stack = [], [], []  # stack: (tag, framed for certain, numbers of the marked elements around, number of the article)
    certain, marks, article = False, (), 0
    around, marked = {}, 0  # around: marked elements in which an outermost article stands

    def flush():
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            out.append((text, certain, marks, article))
        words.clear()

    at, size = 0, len(page)
    while at < size:
        found = _PART.search(page, at)
        if not found:
            words.append(page[at:])
            break
        words.append(page[at:found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            continue
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else size
            words.append(" ")
            continue
        if tag in VOID:
            words.append(" ")
            if tag == "hr":
                flush()
            continue
        kind = 0 if closing else _frame(tag, attributes, bool(article))
        if tag in BLOCKS or tag == "menu":
            flush()
        elif not closing and not kind:
            continue
        if closing:
            if any(s[0] == tag for s in stack):
                if tag not in BLOCKS:
                    flush()
                while stack.pop()[0] != tag:
                    pass
        else:
            flush()
            if tag in SELF_CLOSING and stack and stack[-1][0] in SELF_CLOSING[tag]:
                stack.pop()
                certain, marks, article = stack[-1][1:] if stack else (False, (), 0)
            inside, held = article, marks
            if kind == 1:
                marked += 1
                held = (*marks, marked)
            if not article and (tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes)):
                inside = len(around) + 1
                around[inside] = held
            stack.append((tag, certain or kind == 2, held, inside))
        certain, marks, article = stack[-1][1:] if stack else (False, (), 0)
    flush()
    void = _void_marks(out, around) if marked else set()
    return [(text, certain or any(m not in void for m in marks), article > 0) for text, certain, marks, article in out]


def _void_marks(out, around):
    """Numbers of the marked elements that are a wrapper of the page's article or of the whole page."""
    sizes, of_article, of_mark = 0, {}, {}
    for text, certain, marks, article in out:
        if not certain:
            n = len(text.split())
            sizes += n
            if article:
                of_article[article] = of_article.get(article, 0) + n
            for m in marks:
                of_mark[m] = of_mark.get(m, 0) + n
    if of_article:
        return set(around[max(of_article, key=lambda a: (of_article[a], -a))])
    return {m for m, n in of_mark.items() if n > WHOLE * sizes}


def digests(found):
    return [int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for text, _, _ in found]


def shared(own, other):
    """Places in `own` that lie on a longest common subsequence with `other`; of several, the one found from the front.

    Equal ends are cut off first. What is left between them is solved in (lines x lines / word size) bit operations, and
    traced back over the stored rows (Hyyro, 2004: zero bits of a row mark where the length grows).
    """
    head = 0
    while head < len(own) and head < len(other) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < len(own) - head and tail < len(other) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = own[head:len(own) - tail], other[head:len(other) - tail]
    kept = set(range(head)) | set(range(len(own) - tail, len(own)))
    both = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    masks = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for i in places:
        rows.append(row)
        hit = row & masks[a[i]]
        row = ((row + hit) | (row - hit)) & full
    j = len(b)
    for i, row in zip(reversed(places), reversed(rows)):
        # A match of line i raises the length exactly where the bit of the row after it is cleared.
        hit = row & masks[a[i]]
        after = ((row + hit) | (row - hit)) & full
        low = (1 << j) - 1
        if (~after & low).bit_count() > (~row & low).bit_count():
            kept.add(head + i)
            j = (~after & low).bit_length() - 1
    return kept


def main_text(page, neighbour=None):
    """Blocks of the main text, joined by an empty line.

    Lines that the neighbour shares go, on pages with <article> or <main> too; what stands in these stays. A neighbour that has
    all lines of the page is a copy and tells nothing, nor does one that has none of them: then the text is what stands in
    <article> or <main>, if that has at least half of the words outside frames, and otherwise every line outside frames.
    """
    found = lines(page or "")
    if not found:
        return ""
    common = shared(digests(found), neighbour) if neighbour else set()
    if 0 < len(common) < len(found):
        return "\n\n".join(text for i, (text, framed, article) in enumerate(found) if not framed and (article or i not in common))
    inside, outside = (sum(len(text.split()) for text, framed, article in found if not framed and article == side) for side in (True, False))
    return "\n\n".join(text for text, framed, article in found if not framed and (article or inside < outside))


def nearer(first, second):
    """Key of that of two (path, key) structs, either of them null, whose path has the longer common start with `path`; the first if equal."""
    def common_start(path):
        """Length of the longest common prefix, by halving."""
        pairs = F.zip_with(F.split(F.col("path"), ""), F.split(path, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.coalesce(F.nullif(F.array_position(pairs, False), F.lit(0)) - 1, F.length("path"))

    return F.when(second["key"].isNull(), first["key"]).when(first["key"].isNull(), second["key"]).otherwise(
        F.when(common_start(first["path"]) >= common_start(second["path"]), first["key"]).otherwise(second["key"]))


def nearest(pages):
    """(page_key, neighbour_key) from (page_key, host, path): of the two neighbours in path order the one with the longer
    common start, the earlier if equal.

    Pages are ordered inside a directory block: the host, the path without its last part, and the first two characters of that
    part, so a host that holds a third of all pages is many windows. A page alone in its block has its host's smallest
    page of the directory for a neighbour, found by a folded aggregate; without any it has none here. A slash at the end
    belongs to the last part. `neighbours` goes on to the parent directories and the host.
    """
    last = F.regexp_extract("path", r"[^/]*/?$", 0)
    folder = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(last))
    placed = pages.withColumns({"folder": folder, "block": F.substring(last, 1, 2)})
    order = Window.partitionBy("host", "folder", "block").orderBy("path", "page_key")
    side = {k: F.struct(f("path").over(order).alias("path"), f("page_key").over(order).alias("key")) for k, f in (("lag", F.lag), ("lead", F.lead))}

    near = placed.withColumns(side)
    near = near.select("page_key", "host", "folder", nearer(F.col("lag"), F.col("lead")).alias("neighbour_key"))
    ends = (placed.groupBy("host", "folder").agg(F.min(F.struct("path", "page_key"))["page_key"].alias("low"),
                                                 F.max(F.struct("path", "page_key"))["page_key"].alias("high")))
    alone = near.where("neighbour_key IS NULL").drop("neighbour_key").join(ends, ["host", "folder"])
    other = F.when(F.col("low") != F.col("page_key"), F.col("low")).when(F.col("high") != F.col("page_key"), F.col("high"))
    return (near.where("neighbour_key IS NOT NULL").select("page_key", "neighbour_key")
            .unionByName(alone.select("page_key", other.alias("neighbour_key")).where("neighbour_key IS NOT NULL")))


def neighbours(pages):
    """(page_key, neighbour_key) of every page whose host has another page: as `nearest` has it, and for a page alone in its
    directory from the deepest parent directory, up to the host, that holds another page.

    There it meets, in path order, the pages that are alone in the same way and begin alike (two characters of the next part),
    or else the first or last page below that directory. First and last pages fold up from those of each directory.
    """
    from kinsift.session import materialise

    found = materialise(nearest(pages))
    left = materialise(pages.join(found.select("page_key"), "page_key", "left_anti"))
    if left.isEmpty():
        return found
    place = F.struct("path", F.col("page_key").alias("key"))
    ends = (pages.groupBy("host", F.regexp_extract("path", r"^(.*/)?", 0).alias("folder"))
            .agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("k")))

    def upward(path):
        """The path's directories, the host's own ('') first."""
        parts = F.split(path, "/")
        return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))

    above = (ends.select("host", F.explode(upward(F.col("folder"))).alias("up"), "low", "high", "k").groupBy("host", "up")
             .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("k").alias("k")).where("k > 1"))
    met = left.select("*", F.explode(upward(F.col("path"))).alias("up")).join(above, ["host", "up"])
    deepest = met.groupBy("page_key", "host", "path").agg(F.max_by(F.struct("up", "low", "high"), F.length("up")).alias("at"))
    placed = deepest.select("page_key", "host", "path", "at.*").withColumn("block", F.expr("substring(path, length(up) + 1, 2)"))
    order = Window.partitionBy("host", "up", "block").orderBy("path", "page_key")
    sides = placed.select("*", *[F.struct(f("path").over(order).alias("path"), f("page_key").over(order).alias("key")).alias(k)
                                 for k, f in (("lag", F.lag), ("lead", F.lead))])
    end = {k: F.when(F.col(k)["key"] != F.col("page_key"), F.col(k)) for k in ("low", "high")}
    chosen = F.coalesce(nearer(F.col("lag"), F.col("lead")), nearer(end["low"], end["high"]))
    return found.unionByName(sides.select("page_key", chosen.alias("neighbour_key")))


def extract(pages, page_id="page_id", url="url", html="html"):
    """page_id, url, text and n_chars (code points) of every row.

    Null markup counts as empty and gives an empty text; a null URL, or one without a host, has no neighbour and only its
    markup decides; rows equal in all three columns are one page for the pairing and stay as many rows; an empty table gives
    an empty result; other columns are not looked at. Whole pages are read.
    """
    from kinsift.session import materialise

    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    named = named.withColumn("page_key", row_key("page_id", "url", "html"))
    placed = named.select("page_key", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")

    def digest_lines(batches):
        import pyarrow as pa

        for batch in batches:
            found = [digests(lines(page or "")) for page in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["page_key", "host", "path", "line_digests"])

    lined = materialise(placed.mapInArrow(digest_lines, "page_key string, host string, path string, line_digests array<long>")
                        .dropDuplicates(["page_key"]))
    pairs = neighbours(lined.where("host <> ''").select("page_key", "host", "path"))
    across = pairs.join(lined.select(F.col("page_key").alias("neighbour_key"), "line_digests"), "neighbour_key").drop("neighbour_key")
    met = named.join(across, "page_key", "left").select("page_id", "url", "html", "line_digests")
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page, other) for page, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(cut, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
