"""Template residue and error-page text (problem 5).

A record is split into lines; a line's form is the words of its common form in lower case, with
runs of digits and long hexadecimal ids as one sign, and equal forms are one node. Trusted patterns
label a line either as holding a placeholder or filler, which says nothing about similar lines, or
as a residue statement: an error message, a scripts notice, announced filler. Statements in
wordings that the patterns miss are reached by near-duplicate links: two forms are linked when at
least SIMILAR of their five-word sequences are common. Each form stands in a table under the first
of its sequences in the order of their hashes, so many that two linked forms agree in at least one;
candidates from the table that pass the bounds of near.py on sizes and bitmaps are verified by the
similarity itself, so no link is lost. The label
spreads over the links, round by round, until the connected components that hold a trusted
statement are labelled whole.

A SimHash over the words (`simhashes`, within RADIUS bits) gave 35 % of the links of sf0.1. It finds
no candidates any more and stays as what the tests compare with.

Only links that touch a labelled statement are looked at. Their distinct forms are bounded by the
wordings in use, so the work follows the residue, not the square of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .looks import common_form
from .near import SMALL, WORDS, WordIds, mixed, shingles

RADIUS, SIMILAR, SHINGLE = 3, 0.8, 5

# Names that stand in brackets of a template although they are plain words, and filler words.
NAMES = "nominee|insurer|member|policyholder|name|date|amount|address|title|email|phone|company|product|customer|user|value|number|city|link|url"
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
LATIN_SURE = LATIN - frozenset("sit et ut in ad ex ea eu non id est sed qui sunt quis magna minim enim".split())
_ID = r"[A-Za-z][\w]*(?:[.\-_][\w]+)*"
# What an unfilled placeholder looks like.
PLACEHOLDER = re.compile(
    "|".join([
        r"\{\{[^{}\n]+\}\}", r"\$\{[^{}\n]+\}", r"<<[^<>\n]+>>", r"\[\[[^\[\]\n]+\]\]", r"\{%[^%\n]+%\}", r"<%[^%\n]+%>", rf"@@{_ID}@@", rf"__{_ID}__",
        rf"(?<![\w%])%[A-Za-z]\w*[\w.\-]+%(?!\w)", r"(?<!\S)%[sd](?![\w%])", r"(?<![\w}])\{\d{1,2}\}", rf"\{{{_ID}\}}", rf"<[A-Za-z]\w*(?:[._\-]\w+)+>", rf"<[A-Za-z][a-z]*[A-Z]\w*>", rf"<(?:{NAMES})>",
        rf"\[[A-Za-z]\w*(?:[._]\w+)+\]", rf"\[[a-z]\w*(?:-\w+)+\]", r"\[[a-z]+[A-Z]\w*\]", r"\[[A-Z][a-z]+(?:[A-Z][a-z]+)+\]", rf"\[(?:{NAMES})\]",
        r"\[object object\]", r"(?<![\w-])undefined(?![\w-])", r"(?<![\w-])NaN(?![\w-])(?! bread\b)", r"(?<![\w-])null(?![\w-])(?! and void)(?<!are null)(?<!be null)(?<!is null)", r"#(?:REF|N/A|VALUE|NAME|DIV/0)!?",
        r"\b[dD]{2}[/.-][mM]{2}[/.-][yY]{2,4}\b", r"\b[xX]{2}[/.-][xX]{2}[/.-](?:\d\d)?[xX]{2,4}\b", r"(?i:\b(?:rs\.?|inr)\s*x{1,3}(?:,x{2,3})+)", r"[\[(<][●•_.…\s]+[\])>](?!\w)",
        r"(?i:[\[(<]\s*(?:please )?(?:insert|enter|fill in|add|type|put)\b[^\])>\n]+[\])>])", r"(?i:[\[(<]\s*(?:tbc|tbd|tba|to be (?:confirmed|decided|filled|added|completed|inserted|advised|determined))\b[^\])>\n]*[\])>])",
        r"(?i:\[(?:your |the |our )?(?:company|customer|client|member|insurer|product|policy|policyholder|first|last|full|branch|doctor|hospital) (?:name|number|date|address|id|title)(?: here)?\])", r"(?i:\b\w+(?:-\w+)*-goes-here\b)", r"(?i:\b(?:todo|fixme)\b\s*:)", r"(?i:^\W*(?:dear|to|hello|hi)\s*(?:mr|ms|mrs)?\.?\s*[_.…]{4,})",
    ])
)
# Filler announced in words.
FILLER = re.compile(r"(?i)^\W*(?:(?:sample|dummy|placeholder|filler|test) (?:text|content|copy|paragraph|wording|heading|title) (?:for|about|on|here|goes)\b|(?:your|this|the|more|some) (?:\w+ )?(?:text|content|paragraph|copy|title|heading|description|headline) (?:goes|will go|will appear|comes) here\b|(?:text|content|copy|description) (?:to follow|coming soon|to come)\b)")
# Messages of a failed request. Each pattern is a whole statement of the failure, not a word of it.
FAILED = re.compile(
    "|".join([
        r"\b(?:http|error|status|code)\W{0,3}[45]\d\d\b(?! (?:days|hours|rupees|per))", r"^\W*[45]\d\d\W{0,3}(?:-|\||:|–|\b)\W{0,3}(?:page not found|not found|the file cannot|file not found|forbidden|unauthori[sz]ed|bad (?:request|gateway)|internal server|service (?:is )?(?:temporarily )?unavailable|gateway time-?out|too many requests|method not)",
        r"\b(?:internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|page (?:not found|cannot be found|could not be found))\b", r"\bthe file cannot be located\b",
        r"\bthe (?:requested|page|document)\b.{0,60}\bwas (?:removed|moved|deleted), (?:renamed|moved|removed)\b.{0,40}\bunavailable\b", r"\b(?:access|permission) denied\b\W{0,3}(?:$|you)", r"\byou (?:don['’]t|do not) have permission to (?:open|access|view|see)\b.{0,60}\b(?:on this server|this (?:page|resource))",
        r"\bfatal error\W{1,3}uncaught\b", r"\buncaught (?:exception|error|typeerror) (?:in|at)\b", r"^\W*traceback \(most recent call last\)", r"\bsomething went wrong while we (?:loaded|were loading)\b", r"\b(?:we|it) (?:couldn['’]t|could not|can['’]t|cannot|were unable to) (?:load|display|open|find) (?:this|the|that|your) (?:page|site|resource|content)\b", r"^\W*oops\b.{0,40}\b(?:wrong|error|find)\b",
        r"\btoo many requests\b.{0,60}\b(?:network|retry|again|ip)\b", r"\byour session has (?:expired|ended|timed out)\b", r"\bwe are (?:currently )?down for (?:scheduled )?maintenance\b", r"^\W*(?:this|the) (?:site|page|website|service) is (?:currently |temporarily )?(?:down|unavailable|under maintenance)\b", r"\b(?:connection|request) timed out\b\W*(?:$|please|try)",
    ]), re.I,
)
# Notices that scripts or cookies are needed.
SCRIPTS = re.compile(
    "|".join([
        r"\b(?:please )?(?:enable|activate|turn on|switch on|allow|accept)\b.{0,12}\b(?:javascript|java ?script|js|scripts|scripting|cookies)\b.{0,12}\b(?:to|in your|for|before|and|then)\b", r"\byou need to (?:enable|activate|turn on|switch on|allow)\b.{0,12}\b(?:javascript|scripting|scripts|cookies)\b",
        r"\b(?:requires?|needs?)\s+(?:that )?(?:javascript|js|scripts|cookies)\b", r"\b(?:javascript|js|scripting|scripts?|cookies)(?: (?:and|or) (?:javascript|js|scripts?|cookies))? (?:must be|has to be|have to be|is|are) (?:enabled|allowed|required|disabled|off|(?:turned|switched) (?:on|off)|activated|blocked)\b",
        r"\byour browser (?:does not|doesn['’]t) support (?:javascript|js|scripts|cookies)\b", r"^\W*checking your browser before\b", r"^\W*(?:please )?(?:verify|confirm) (?:that )?you are (?:human|not a robot)\b", r"\bad ?blocker\b.{0,40}\b(?:disable|turn|switch)",
    ]), re.I,
)
ID = re.compile(r"(?=[0-9a-f]*\d)[0-9a-f]{6,}")
DIGITS = re.compile(r"\d+")


def is_filler(words: list[str]) -> bool:
    if len(LATIN_SURE.intersection(words)) < 2:
        return False
    latin = sum(w in LATIN for w in words)
    return latin >= 4 and 2 * latin >= len(words) or {"lorem", "ipsum"} <= set(words)


NONE, PART, STATEMENT = 0, 1, 2


# At least one of these stands in every text that a pattern can match.
SIGNS = re.compile(r"[\[{<%@_#$●]")
PLACEHOLDER_WORDS = "undefined null nan ____ dd/ dd- dd. xx goes-here todo fixme (insert (enter (please (fill (add (type (put (tbc (tbd (tba (to (• (. (_ (…".split() + ["( "]
STATEMENT_WORDS = ["http", "error", "status", "not found", "cannot be", "file cannot", "could not be", "denied", "permission", "unavailable", "gateway", "forbidden", "unauthori", "bad request", "method not", "uncaught", "traceback", "went wrong", "oops", "too many requests", "session has", "maintenance", "timed out", "is down", "is currently", "is temporarily", "code",
                   "javascript", "java script", "js ", "script ", " scripts", "scripts ", "scripting", "internal server", "cookies", "your browser", "you are human", "not a robot", "adblock", "ad block", "t load", "not load", "display", "unable to", "t open", "not open", "t find", "not find", "sample ", "dummy ", "placeholder ", "filler ", "test text", "test co", "test para", "test wor", "test hea", "test tit", " here", "to follow", "coming soon", "to come"]


@cache
def finder() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for bit, words in ((1, PLACEHOLDER_WORDS), (2, STATEMENT_WORDS)):
        for w in words:
            found.add_word(w, found.get(w, 0) | bit)
    found.make_automaton()
    return found


def may_have(text: str) -> tuple[bool, bool]:
    """Whether a text can hold a placeholder, and whether it can hold a statement; both are cheap."""
    bits = 0
    for _, bit in finder().iter(text.lower()):
        bits |= bit
        if bits == 3:
            break
    return bool(bits & 1 or SIGNS.search(text)), bool(bits & 2)


# A message between quotation marks within a sentence, which speaks of the message.
SPOKEN_OF = re.compile(r"(?<!\S)['\"‘“][^'\"‘’“”\n]{1,80}['\"’”](?=[,.;:)\s]|$)")


def trusted(line: str, words: list[str], placeholder: bool = True, statement: bool = True) -> int:
    """NONE, PART (placeholder or filler) or STATEMENT of a line in the common form, with its words."""
    if statement:
        own = SPOKEN_OF.sub(" ", line)
        own = own if WORDS.search(own) else line  # a line that is quoted whole is the message itself
        if FAILED.search(own) or SCRIPTS.search(own) or FILLER.search(own):
            return STATEMENT
    return PART if placeholder and PLACEHOLDER.search(line) or is_filler(words) else NONE


def simhashes(lines: list[np.ndarray], block: int = 2000) -> list[int]:
    """64 votes of the words of each line; a tie is a 0. Lines without words hash to 0. A word takes
    some 300 bytes while it votes, so lines are counted in blocks."""
    out: list[int] = []
    for i in range(0, len(lines), block):
        part = lines[i : i + block]
        size = np.array([len(w) for w in part])
        ends = np.cumsum(size)
        bits = np.unpackbits(mixed(np.concatenate(part)).view(np.uint8).reshape(-1, 8), axis=1)
        total = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        votes = total[ends] - total[ends - size]
        out += np.packbits(2 * votes > size[:, None], axis=1).view(np.int64).ravel().tolist()
    return out


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Of n sequences, how many a form stands under: a linked form lacks fewer than these."""
    return n - np.ceil(SIMILAR * n - 1e-9).astype(np.int64) + 1


def prefixes(lines: list[np.ndarray]) -> pa.ListArray:
    return sequences(lines)[2]


def sequences(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Of each line: how many five-word sequences it has, their 64-bit bitmap, and the hashes of those
    that it stands under; none if it has fewer words, since such a line is similar only to itself."""
    of, words = np.repeat(np.arange(len(lines)), [len(w) for w in lines]), np.concatenate([*lines, np.empty(0, np.uint64)])
    end = max(0, len(words) - SHINGLE + 1)
    h = words[:end]
    for i in range(1, SHINGLE):
        h = mixed(h) + words[i : end + i]
    inside = of[:end] == of[SHINGLE - 1 :][:end]
    h, of = mixed(h)[inside], of[:end][inside]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
    h, of = h[new], of[new]
    n = np.bincount(of, minlength=len(lines))
    taken = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(prefix_size(n), n)
    ends = np.append(0, np.cumsum(np.bincount(of[taken], minlength=len(lines)))).astype(np.int32)
    maps = np.zeros(len(lines), np.uint64)
    np.bitwise_or.at(maps, of, np.uint64(1) << (h & np.uint64(63)))
    return n, maps.view(np.int64), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[taken].view(np.int64)))


def form_of(line: str) -> list[str]:
    """The words of a line in lower case; long hexadecimal ids are one sign, runs of digits a 0."""
    words = WORDS.findall(line.lower())
    if DIGITS.search(line):
        return [w if w.isalpha() else "#" if ID.fullmatch(w) else DIGITS.sub("0", w) for w in words]
    return words


def form_id(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - 2**63


def line_forms(records: DataFrame, key: str, text: str) -> DataFrame:
    """(id, form, kind, n, map, prefix): the distinct lines of every record that have a word or a trusted pattern."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in batches:
            at: list[int] = []
            of: list[int] = []
            met: dict[str, int] = {}  # each different line of the batch is looked at once
            ids, kinds, words = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                t = common_form(t).replace("\f", "\n")
                may = may_have(t)
                mine = set()
                for line in t.split("\n"):
                    j = met.get(line)
                    if j is None:
                        w = form_of(line)
                        kind = trusted(line, w, *may)
                        if not w and not kind:
                            continue
                        j = met[line] = len(ids)
                        ids.append(form_id(w))
                        kinds.append(kind)
                        words.append(known.of(w))
                    mine.add(j)
                at += [i] * len(mine)
                of += mine
            line = pa.array(of, pa.int64())
            n, maps, under = sequences(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()).take(line), pa.array(kinds, pa.int8()).take(line), pa.array(n, pa.int32()).take(line), pa.array(maps).take(line), under.take(line)], ["id", "form", "kind", "n", "map", "prefix"])

    kind = records.schema[key].dataType.simpleString()
    return records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(rows, f"id {kind}, form bigint, kind tinyint, n int, map bigint, prefix array<bigint>")


def _sent(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.count() <= SMALL // 4 else few


def _table(forms: DataFrame) -> DataFrame:
    """One row per form and sequence that it stands under."""
    return forms.select("form", "n", "map", F.explode("prefix").alias("gram"))


def _grams_of(records: DataFrame, key: str, text: str, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(form, grams) of the wanted forms, read from one record that has each."""
    held = lines.select("id", "form").join(_sent(wanted), "form", "left_semi").groupBy("form").agg(F.min("id").alias("id"))
    per_record = _sent(cut(held.groupBy("id").agg(F.collect_set("form").alias("forms"))))
    found = records.select(F.col(key).alias("id"), F.col(text).alias("t")).join(per_record, "id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in batches:
            out: dict[int, np.ndarray] = {}
            for t, forms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line in common_form(t).replace("\f", "\n").split("\n"):
                    words = form_of(line)
                    if words and form_id(words) in forms:
                        ids = known.of(words)
                        out[form_id(words)] = shingles(ids, min(SHINGLE, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([g.view(np.int64).tolist() for g in out.values()], pa.list_(pa.int64()))], ["form", "grams"])

    return found.select("t", "forms").mapInArrow(rows, "form bigint, grams array<bigint>").groupBy("form").agg(F.first("grams").alias("grams"))


def spread(records: DataFrame, key: str, text: str, lines: DataFrame) -> DataFrame:
    """(form) of all statements: the trusted ones and whatever near-duplicate links connect with them."""
    table = _table(lines.where(f"kind <> {STATEMENT}"))
    labelled = cut(lines.where(f"kind = {STATEMENT}").select("form", "n", "map", "prefix").dropDuplicates(["form"]))
    frontier = labelled
    missing = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))
    common = F.least(F.col("n") - missing("map", "seed_map"), F.col("seed_n") - missing("seed_map", "map"))  # at most
    while True:  # every round labels a form more, or is the last
        near = cut(_table(frontier).select(F.col("form").alias("seed"), F.col("n").alias("seed_n"), F.col("map").alias("seed_map"), "gram"))
        close = table.join(_sent(near), "gram").where((1 + SIMILAR) * common >= SIMILAR * (F.col("n") + F.col("seed_n")) - 1e-9).select("form", "n", "map", "seed").dropDuplicates(["form", "seed"])
        close = cut(close.join(labelled.select("form"), "form", "left_anti"))
        if close.isEmpty():
            return labelled.select("form")
        grams = cut(_grams_of(records, key, text, lines, close.select("form").unionByName(close.select(F.col("seed").alias("form"))).distinct()))
        both = close.join(grams, "form").join(grams.select(F.col("form").alias("seed"), F.col("grams").alias("seed_grams")), "seed")
        alike = F.size(F.array_intersect("grams", "seed_grams")) >= SIMILAR * F.size(F.array_union("grams", "seed_grams"))
        size = F.size("grams")  # grams ascend as prefixes() orders them
        frontier = cut(both.where(alike).select("form", "n", "map", F.slice("grams", F.lit(1), (size - F.ceil(SIMILAR * size - 1e-9) + 1).cast("int")).alias("prefix")).dropDuplicates(["form"]))
        if frontier.isEmpty():
            return labelled.select("form")
        labelled = cut(labelled.unionByName(frontier))


def residue(records: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key): the records with template residue, error-page text or a scripts notice in any line.

    Null keys and texts take no part; repeated rows count once; empty input gives no rows. Other
    columns are ignored."""
    lines = line_forms(records, key, text).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        marked = lines.where(f"kind <> {NONE}").select("id").unionByName(lines.select("id", "form").join(_sent(spread(records, key, text, lines)), "form", "left_semi").select("id"))
        return cut(marked.distinct()).select(F.col("id").alias(key))
    finally:
        lines.unpersist()
