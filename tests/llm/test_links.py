"""Near-duplicate links of residue lines: all of them, whatever their SimHash says."""

import random

from clausewright.llm import residue

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def changed(rng, line):
    """The line with its last or first word replaced, or a word put in front."""
    return [[*line[:-1], "zz"], ["zz", *line[1:]], ["zz", *line]][rng.randrange(3)]


def grams(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_every_similar_pair_shares_a_table_entry():
    rng, known, similar, near = random.Random(3), residue.WordIds(), 0, 0
    for n in [*range(5, 70)] * 6:
        a = [rng.choice(WORDS) for _ in range(n)]
        b = changed(rng, a)
        if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)):
            ids = [known.of(a), known.of(b)]
            p, q = residue.prefixes(ids).to_pylist()
            assert set(p) & set(q)
            ha, hb = residue.simhashes(ids)
            similar, near = similar + 1, near + (bin((ha ^ hb) & (2**64 - 1)).count("1") <= residue.RADIUS)
    assert similar > 300 and near < 0.6 * similar
    assert residue.prefixes([known.of(["one", "two"]), known.of([])]).to_pylist() == [[], []] and residue.prefixes([]).to_pylist() == []


def test_label_reaches_a_short_line_with_another_end(spark):
    rng, known, seeds, close = random.Random(4), residue.WordIds(), [], []
    while len(seeds) < 5:
        a = "your session has expired".split() + [rng.choice(WORDS) for _ in range(16)]
        b = ["our", *a[1:]]
        ha, hb = residue.simhashes([known.of(a), known.of(b)])
        if bin((ha ^ hb) & (2**64 - 1)).count("1") > residue.RADIUS:
            seeds.append(" ".join(a))
            close.append(" ".join(b))
    chain = " ".join([*close[0].split()[:-1], "zz"])  # reached over a link of a link
    rows = [(f"s{i}", x) for i, x in enumerate(seeds)] + [(f"c{i}", x) for i, x in enumerate(close)] + [("chain", chain), ("far", " ".join(WORDS[:20]))]
    got = {r[0] for r in residue.residue(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    assert got == {x for x, _ in rows} - {"far"}


def test_every_pattern_passes_the_word_filter():
    said = ["Script must be enabled", "500 Internal Server", "Scripts are required", "Java script is disabled", "Please enable scripting in your browser", "Checking your browser before access", "403 Forbidden", "401 Unauthorized", "400 Bad Request", "502 Bad Gateway", "405 Method not allowed",
            "429 too many requests", "404 File not found", "404 the file cannot", "The file cannot be located", "the page was removed, renamed or is unavailable", "Access denied", "You don't have permission to view this page", "Uncaught TypeError in", "Traceback (most recent call last)", "Something went wrong while we loaded", "Oops, wrong",
            "Your session has expired", "We are down for maintenance", "The site is down", "Request timed out", "503 service unavailable", "504 gateway time-out", "code 404", "This requires cookies", "Sample text for", "Your text goes here", "Text to follow", "Copy coming soon"]
    for line in said:
        assert residue.FAILED.search(line) or residue.SCRIPTS.search(line) or residue.FILLER.search(line), line
        assert residue.may_have(line)[1], line


def test_messages_are_told_from_what_speaks_of_them():
    bad = ["We couldn't load this page. Try again later.", "Verify you are human by completing the action below.", "Dear ____________,", "Scripting is off. Without it the card cannot be shown.", "'Page not found'", "Plan <LimitValue> applies", "404 - page not found"]
    good = ["If the desk shows 'page not found', the nominee may send the form by post.", "Fees are null under section 4.", "The NaN bread clause", "Members whose browser blocks scripts can call.", "Room category XX in annexure D means cover.", "An error in the form found by the broker is settled."]
    kinds = [residue.trusted(x, residue.form_of(x), *residue.may_have(x)) for x in bad + good]
    assert [bool(k) for k in kinds] == [True] * len(bad) + [False] * len(good), list(zip(kinds, bad + good))
