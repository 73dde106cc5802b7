import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from clausewright.llm import lines, near, packing, pairs, reading, residue, split
from clausewright.llm.looks import common_form, same_looks

CHUNK = "chunk_id string, source_id string, text string, pages array<int>, id string, grp string, n int"


def chunks(spark, rows):
    return spark.createDataFrame([(c, s, t, [1, 2, 3], "clash", "clash", 0) for c, s, t in rows], CHUNK)


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        base = words(rng, rng.randrange(4, 160))
        for k in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice("abcdef") * 3
            rows.append((f"c{g}_{k}", "s", " ".join(w).upper() if k == 2 else " ".join(w)))
    rows += [("x1", "s", "one two"), ("x2", "s", "one two"), ("n", "s", None), (None, "s", "a b c d"), ("e", "s", ""), rows[0]]
    got = {tuple(r) for r in near.group_pairs(near.near_duplicates(chunks(spark, rows), "chunk_id", "text"), "chunk_id").collect()}
    sets = {}
    for c, _, t in rows:
        if c and t:
            w = near.text_words(t)
            sets[c] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    root = {c: c for c in sets}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if find(a) == find(b)}
    assert got == want and len(want) > 20
    assert near.near_duplicates(chunks(spark, []), "chunk_id", "text").count() == 0


def test_hot_block_is_cut_into_a_grid(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    cells = spark.createDataFrame([(7, i) for i in range(10)] + [(8, 1), (8, 1), (9, 2), (9, 5)], "col long, cls long")
    got = {(r["a"], r["b"]): r["shared"] for r in near.product(cells).collect()}
    want = {(a, b): 1 for a, b in itertools.combinations(range(10), 2)}
    want[2, 5] = 2
    assert got == want


@pytest.mark.parametrize(("a", "b"), [("ＡＢＣ １２", "ABC 12"), ("oﬃce", "office"), ("é", "é"), ("a​b", "ab"), ("a b c\td", "a b c d"), ("Сооr", "Coor"), ("e​́", "é"), ("a\r\nb", "a\nb"), ("вй", "вй"), ("ё", "ë"), ("soft­ly", "softly")])
def test_same_look(a, b):
    assert common_form(a) == common_form(b)


@pytest.mark.parametrize("t", ["20 m²", "naïve", "A a", "x\ny", "½", "a  b", "क्‍ष", "", None, "ж и", "\U0001f469‍\U0001f467"])
def test_visible_things_stay(t):
    assert common_form(t) == t


def test_common_form_is_stable():
    rng = random.Random(1)
    pool = "aé́̈​‍СοﬁＡ ­²ñ\n\f अ्가"
    for _ in range(500):
        once = common_form("".join(rng.choice(pool) for _ in range(12)))
        assert common_form(once) == once


def test_same_looks_pairs(spark):
    rows = [("a", "s", "file x"), ("b", "s", "ﬁle x"), ("c", "t", "file​ x"), ("d", "t", "file x"), ("e", "s", "File x"), ("n", "s", None), ("b", "s", "ﬁle x")]
    assert {tuple(r) for r in same_looks(chunks(spark, rows)).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}


def test_repeated_lines_in_one_or_many_partitions(spark):
    rows = [(f"c{i}", "s", f"Body {'abcdefgh'[i]}\n  Legal  NOTICE {i} \nLegal notice 77\n12") for i in range(6)] + [("z", "t", "Legal notice 1"), ("q", None, "Legal notice 1"), ("n", "s", None), ("c0", "s", "Body a\n  Legal  NOTICE 0 \nLegal notice 77\n12")]
    df = chunks(spark, rows)
    want = {(f"c{i}", n) for i in range(6) for n in (2, 3)}
    assert {tuple(r) for r in lines.repeated_lines(df).collect()} == want
    recs = lines.records(df, "chunk_id", "source_id", "text")
    state = lines.LineState.empty(recs)
    crossed = []
    for part in (recs.where("id < 'c3'"), recs.where("id >= 'c3'"), recs):
        state, new = state.merge(part)
        crossed.append(new.count())
    assert crossed == [0, 1, 0]
    built = {r["id"]: r["text"] for r in lines.rebuilt(recs, lines.repeated_lines(df).withColumnRenamed("chunk_id", "id")).collect()}
    assert built["c1"] == "Body b\n12" and "z" not in built
    assert lines.repeated_lines(chunks(spark, [])).count() == 0


QUESTION = "How long must the broker wait before dialysis sitting can be paid?"


@pytest.mark.parametrize(("answer", "want"), [
    (None, "empty"), (" ", "empty"), ("N/A", "empty"), ("...", "empty"), ("​", "empty"), ("[]", "empty"), (QUESTION, "copied_question"), (QUESTION.upper().rstrip("?"), "copied_question"), ('You asked: "' + QUESTION + '"', "copied_question"), (QUESTION + " " + QUESTION, "copied_question"),
    (QUESTION + " Six weeks after the notice reaches the desk.", None), ("I cannot answer this from the passages.", "refusal"), ("**Note:** Sorry, no comment on this one.", "refusal"), ("The insurer cannot refuse dialysis sitting on the ground of asthma; it can only be refused with consent.", None),
    ("Unfortunately dialysis is excluded for asthma, so the broker bears the cost.", None), ("The broker must hand in the claim form and the", "truncated"), ("Yes, dialysis is paid once th-", "truncated"), ("66 nights", None), ("up to 28% of the sum insured", None), ("No", None),
    ("Ja, die Zahnbehandlung wird nach der Wartezeit erstattet, sobald der Ausweis vorliegt.", "wrong_language"), ("Rs. 4,07,000", None), ("Haan, kamre ka kiraya mil jaata hai, bas kaagaz jama karna hoga.", "wrong_language"),
])
def test_defects(answer, want):
    assert pairs.defect(QUESTION, answer, None) == want


def test_cut_output_and_pairs(spark):
    assert pairs.output_cut('{"a": "b') and pairs.output_cut('```json\n{"a": [1') and not pairs.output_cut('```json\n{"a": "}"}\n```') and not pairs.output_cut(None)
    q = spark.createDataFrame([("g", QUESTION), ("g", QUESTION), (None, "x")], "id string, question string")
    a = spark.createDataFrame([(1, "g", "", None, None), (1, "g", "", None, None), (2, "g", "", None, True), (3, None, None, None, False), (None, "g", "", None, None), (4, "g", "Six weeks.", None, None)], "answer_id long, id string, answer string, gen_raw string, declined boolean")
    assert {tuple(r) for r in pairs.defective_pairs(q, a).collect()} == {(1, "empty"), (3, "empty")}


def test_residue_and_its_spread(spark):
    frame = "the page that you asked for could not be shown to you just now because something went wrong while we loaded the {} page and so we ask that you come back to this place at some later time of the day or call the desk of the branch next door"
    bad = ["Dear {{insurer_name}},", "Pay [INSERT DATE] please", "HTTP 404 - page not found", "Please enable JavaScript to view this.", "Lorem ipsum dolor sit amet", "x\n503 Service Unavailable\ny", frame.format("claim"), "Rate %nominee% due"]
    good = ["The spouse [or nominee] signs.", "Benefit = {a + b} x 4", "An error in the claim form found by the broker is settled.", "Members whose browser blocks scripts can call.", "Placeholder cover notes lapse.", "rise by 5% when <45 years of cover", "Access to the desk is denied to a broker without the form.", "null and void"]
    near_miss = frame.format("claim").replace("something went wrong while we loaded the claim page", "something went wrong while we loded the claim page")
    rows = [(f"b{i}", "s", t) for i, t in enumerate(bad)] + [(f"g{i}", "s", t) for i, t in enumerate(good)] + [("n", "s", None), ("e", "s", "")]
    got = {r[0] for r in residue.residue(chunks(spark, [*rows, rows[0]])).collect()}
    assert got == {f"b{i}" for i in range(len(bad))}
    a, b = (residue.form_of(frame.format("claim")), residue.form_of(near_miss))
    known = residue.WordIds()
    ha, hb = residue.simhashes([known.of(a), known.of(b)])
    spreads = bin((ha ^ hb) & (2**64 - 1)).count("1") <= residue.RADIUS
    got = {r[0] for r in residue.residue(chunks(spark, [("m", "s", near_miss), ("b", "s", frame.format("claim"))])).collect()}
    assert got == ({"b", "m"} if spreads else {"b"})
    assert residue.residue(chunks(spark, [])).count() == 0


def test_label_reaches_a_close_wording(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03}")
    long = " ".join(name(i) for i in range(200))
    rows = [("seed", "s", f"{long} your session has expired today"), ("close", "s", f"{long} your seshun has expired today"), ("far", "s", " ".join(name(i) + "z" for i in range(200)))]
    assert {r[0] for r in residue.residue(chunks(spark, rows)).collect()} == {"seed", "close"}


def test_pieces_keep_the_text_and_the_limit(spark):
    rng = random.Random(2)
    for n in (0, 1, 1200, 1201, 5000):
        text = "".join(rng.choice(["word ", "other. ", "line\n", "\n\n", "p\n\f\n", "clause, "]) for _ in range(n // 5 + 1))[:n]
        got = split.pieces(text, [4, 5, 6])
        assert all(len(p) <= 1200 for _, p, _, _ in got)
        starts = [own for _, _, own, _ in got] + [len(text)]
        assert "".join(text[a:b] for a, b in zip(starts[:-1], starts[1:])) == text
        for (_, before, _, _), (_, p, own, pages) in zip(got[:-1], got[1:]):
            shared = len(p) - len(text[own : own + len(p)]) if own + len(p) > len(text) else next(k for k in range(121) if text[own - k : own - k + len(p)] == p)
            assert pages and shared <= 120 and before.endswith(p[:shared])
    got = split.pieces("x" * 5000, None)
    assert all(len(p) <= 1200 for _, p, _, _ in got) and got[0][3] is None
    assert split.pieces("a" * 700 + "\f" + "b" * 900, [3, 4])[-1][3][-1] == 4
    df = chunks(spark, [("a", "s", "x y " * 500), ("b", "s", "short"), ("n", "s", None), ("a", "s", "x y " * 500)])
    rows = split.split_oversized(df).collect()
    assert {r["chunk_id"] for r in rows} == {"a"} and len({r["piece_no"] for r in rows}) == len(rows) > 1


FILES = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(FILES), reason="no vocabulary")
def test_ids_equal_another_encoder_and_round_trip(spark):
    import base64

    import tiktoken

    from clausewright.llm import tokens

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILES, "rb"))}
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = tokens.encoder(FILES)
    rng = random.Random(3)
    texts = ["", "<|endoftext|>", "don't  stop\n\n x", "a" * 3000, "हिन्दी ½²", "\x00\x1f\x85", "\U0001f469 ok", *("".join(chr(rng.choice([32, 10, rng.randrange(33, 800), rng.randrange(0x900, 0x3000)])) for _ in range(60)) for _ in range(200))]
    for t in texts:
        assert coder.encode(t) == other.encode_ordinary(t) and coder.decode(coder.encode(t)) == t
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi there"), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df, "doc_id", "text", FILES).collect()}
    assert got[1] == got[2] == [] and coder.decode(got[3]) == "hi there" and None in got


def test_containers(spark):
    rng = random.Random(4)
    sizes = [(i, rng.randrange(0, 120)) for i in range(500)] + [(900, 1000), (901, None), (None, 7)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, tokens int"), "doc_id", "tokens", 128).collect()
    load, at = {}, {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["size"]
        at.setdefault(r["container_id"], []).append((r["at"], r["size"]))
    assert max(load.values()) <= 128 and sum(load.values()) == sum(s for _, s in sizes if s)
    for spans in at.values():
        spans.sort()
        assert all(a + s == b for (a, s), (b, _) in zip(spans[:-1], spans[1:]))
    assert sorted(r["size"] for r in rows if r["doc_id"] == 900) == [104] + [128] * 7
    assert sum(load.values()) / (128 * len(load)) > 0.95
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int"), "doc_id", "tokens", 128).count() == 0


def test_reading_bands(spark):
    easy, hard = "You can ask the team at home. ", "Notwithstanding any irrevocable presumption contemplated hereunder the indemnification obligation of the undertaking supersedes every discretionary entitlement attributable to the beneficiaries and the reinsurance arrangement. "
    docs = [(i, easy * 15) for i in range(8)] + [(10 + i, hard * 6) for i in range(8)] + [(20, easy), (21, None), (22, ""), (23, "Sin el informe no hay pago para la familia. " * 20), (24, "क्या यह देय है। " * 40)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, band int")
    labels = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (1, 1, "a"), (2, 2, "b"), (3, 1, "a"), (10, 4, "a"), (11, 4, "b"), (None, 2, "a")], "doc_id long, band int, rater string")
    got = {r["doc_id"]: r["band"] for r in reading.reading_bands(df, labels.where("band <> 2 or doc_id is null")).collect()}
    assert got == {i: 1 for i in range(8)} | {10 + i: 4 for i in range(8)}
    assert {r["band"] for r in reading.reading_bands(df, labels.where("false")).collect()} == {None}


def test_ranks_that_do_not_travel_are_joined(spark):
    """However few ranks are sent, the measures are those of a count by hand."""
    import math
    import re
    from collections import Counter

    rng = random.Random(9)
    spoken = [f"w{i}" for i in range(400)]
    texts = {i: "the offer is for you. " * 3 + " ".join(rng.choices(spoken, [1 / (1 + j) for j in range(400)], k=80 + i)) for i in range(30)}
    count = Counter(w for t in texts.values() for w in re.findall(r"\w+", t))
    rank = {w: 1 + sum(m > n for m in count.values()) for w, n in count.items()}
    want = {}
    for i, t in texts.items():
        places = sorted(rank[w] for w in re.findall(r"\w+", t))
        want[i] = round(math.log(places[math.ceil(0.6 * len(places)) - 1]), 9)
    parse = reading.parsed(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3))
    ranks = reading.word_ranks(parse)
    for sent in (0, 5, 40, 50_000):
        assert {r["doc_id"]: round(r["vocabulary"], 9) for r in reading.measures(parse, ranks, sent).collect()} == want
    assert reading.parsed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("answer", ["I won't be able to help with that.", "That falls outside what I can discuss.", "I'd rather not answer.", "Não posso responder a essa pergunta.", "The bonus is paid once a year after the review of the claim by the desk in the city of the branch, said the leaflet. Apart from that I must decline to answer."])
def test_refusals_anywhere_and_in_other_words(answer):
    assert pairs.defect("What does the bonus depend on for the family?", answer, None) == "refusal"


def test_no_refusal_in_statements_of_the_insurer():
    for answer in ("The insurer cannot refuse the claim; it must answer within thirty days.", "We pay the bill when the hospital can answer.", "Six months from the policy start date", "No se paga sin el informe."):
        assert pairs.defect(None, answer, None) is None


def test_subsequence_by_bits():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            diag = 0
            for j, y in enumerate(b, 1):
                diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
        assert pairs.common_subsequence(a, b) == row[-1]


def test_language_profiles(spark):
    rows = [("en", "the committee decides whether such treatment remains reimbursable throughout every calendar year"), ("de", "sämtliche Behandlungskosten übernimmt grundsätzlich unsere Krankenversicherung vollständig"), ("EN-gb", None), ("und", "xyz xyz xyz"), (None, "abc")]
    known = pairs.profiles(spark.createDataFrame(rows * 3, "lang string, text string"))
    assert set(known) == {"en", "de"}
    assert pairs.language("Behandlungskosten übernimmt Krankenversicherung vollständig", known) == "de" and pairs.language("1200", known) is None
    assert pairs.profiles(spark.createDataFrame([], "lang string, text string")) == {}


def test_an_announced_question_is_a_copy():
    q = "Wird die Augenoperation während des Aufenthalts erstattet?"
    for head in ("The question is: ", "You asked: ", "Q: "):
        assert pairs.defect(q, head + q, None) == "copied_question"
