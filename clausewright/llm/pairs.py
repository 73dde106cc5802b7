"""Defective pairs of a question and its answer (problem 4).

A pair gets at most one type, the first that holds: empty, copied_question, refusal, truncated,
wrong_language. Question and answer are aligned as word sequences: shingle containment and the
longest common subsequence tell a copy of the question from an answer that restates it. Refusals are
aligned with templates anywhere in the answer: with wordings, by the longest common subsequence and
the containment of word pairs in the best stretch, and with frames, whose slots each take any of
several words. Languages are told by frequent words and, where these say nothing, by profiles of
three letters that are counted on labelled documents.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .looks import common_form

LABELLED = 20_000  # labelled documents that the profiles are counted on, about
GRAMS = 3000  # most frequent sequences of three letters kept of a language

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[ऀ-ॿ]+")
# Words that stand for no answer.
NO_ANSWER = frozenset({"null", "none", "n a", "na", "nil", "unknown", "not applicable", "nan", "undefined", "no answer", "empty", "blank", "tbd", "keine", "keine angabe", "aucune", "aucun", "ninguno", "ninguna", "sin respuesta"})
# Wordings of refusals; * stands for any words.
REFUSALS = [
    "i do not have enough information to say anything about", "i don't have enough information to answer", "i cannot answer this", "i can't answer this", "i am unable to answer this", "i'm not able to answer this", "i cannot assist with questions about", "i cannot answer questions about",
    "i'm sorry but i cannot", "i'm sorry but i can't help", "as a language model i am not able to", "as an ai i cannot", "unable to comply the system may not discuss", "the passages do not tell me about * therefore i must decline to answer", "i must decline to answer", "sorry no comment on this one",
    "apologies that is something i can't discuss", "this request goes against my guidelines", "so i won't comment on", "i can't discuss", "i am not allowed to",
    "मैं इस विषय में सहायता करने में असमर्थ हूँ", "मैं इस प्रश्न का उत्तर नहीं दे सकता", "diese frage kann ich nicht beantworten", "dazu darf ich leider keine auskunft geben", "no puedo responder a esa pregunta", "je ne peux pas répondre à cette question",
]
# Words that announce a repeated question.
WRAPPERS = [["the", "question", "is"], ["your", "question", "is"], ["your", "question", "was"], ["you", "asked"]]
# Frames of refusals; every slot takes one of its words, in this order, within SPAN words.
SPEAK = "answer help assist discuss comment respond say speak advise tell reply engage"
FRAMES = [
    tuple(frozenset(slot.split()) for slot in frame) for frame in (
        ("i we i'm we're assistant model system", "cannot can't won't unable not decline refuse couldn't", SPEAK + " discussing answering commenting"), ("i'd we'd i we", "rather prefer choose wish", "not", SPEAK), ("outside beyond", "i we my our", SPEAK + " scope remit guidelines"),
        ("against", "my our", "guidelines policies rules"), ("not", "enough sufficient", "information context", "to"), ("no", "comment"), ("ich wir", "kann darf möchte können dürfen", "nicht keine kein leider", "beantworten antworten helfen auskunft sagen kommentieren"), ("frage", "kann darf", "ich wir", "nicht", "beantworten"),
        ("je nous", "ne", "peux pouvons puis suis souhaite", "pas", "répondre aider commenter discuter dire"), ("no", "puedo podemos debo quiero", "responder contestar ayudar ayudarle comentar hablar opinar"), ("não nao", "posso podemos devo quero", "responder ajudar comentar falar"),
        ("मैं हम", "उत्तर जवाब मदद सहायता टिप्पणी", "नहीं असमर्थ"),
    )
]
SPAN = 14
# Frequent words by language; hi is Hindi in Latin letters as well.
SPOKEN = {
    "en": "the a an is are was for of to and in on by with what who how which does must can my your when be not from that this it or once after before during paid i you up if we any our only yes about tell as at because whenever".split(),
    "de": "der die das ist wird werden und ein eine nicht für bei mit den dem im auf nach wenn oder ja nein sobald innerhalb zusammen auch ab von zu muss ohne kann nur ich beide".split(),
    "fr": "le la les des est sont et un une pas pour dans avec du au sur après quand oui non si par pendant ou que ensemble est-ce faut-il l' d' sans ce cette je lors il elle ne en doit fournit fournir obtenir envoyer charge jours année cours demande leur".split(),
    "es": "el la los las es se y un una para en con del al por después cuando sí si durante o que juntos paga pagan desde hace falta sin a vez de lo puedo".split(),
    "hi": "hai hain ka ke ki ko se mein par aur nahin nahi haan bas tak liye kya jo yeh is hoga hogi jaata jaate karna karne dono milte mil andar baad".split(),
}
BY_WORD = {w: frozenset(k for k, v in SPOKEN.items() if w in v) for v in SPOKEN.values() for w in v}
AMOUNT = re.compile(r"^(?:(?:up to|at most|bis zu|jusqu['’]à|hasta|about)\s+)?(?:(?:rs\.?|inr|eur|usd|₹|€|\$)\s*)?\d[\d,. ]*\s*(?:%|per ?cent|percent|rupees|euros?|[^\W\d]+(?: [^\W\d]+)?)?(?:\s+of the sum insured)?\W*$", re.I)
SHARE = re.compile(r"^(?:up to|at most)\b.*\bof the sum insured\W*$", re.I)
# Numbers in words.
COUNTS = frozenset("one two three four five six seven eight nine ten eleven twelve fifteen twenty twenty-four thirty forty forty-five fifty sixty ninety hundred half".split())
# Words no statement ends with.
OPEN_END = frozenset("the a an of to and or with for by in on at from if that because between after before than as but so der die das und oder mit für von zu le la les des du et ou de avec pour el los las del y con para por en un una que ein eine bei den dem".split())


def tokens(text: str) -> list[str]:
    return [w.replace("’", "'") for w in TOKEN.findall(text.lower())]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. The words of `a` are the bits of one number, and a
    step over a word of `b` is an addition, so the work is one operation per word of `b`."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = open_ = (1 << len(a)) - 1
    for y in b:
        if at := places.get(y, 0) & open_:
            open_ = (open_ + at | open_ - at) & every
    return len(a) - open_.bit_count()


def containment(part: list[str], whole: list[str], k: int = 3) -> float:
    """The share of the k-word sequences of `part` that are in `whole`; shorter texts are one sequence."""
    k = max(1, min(k, len(part), len(whole)))
    mine = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
    theirs = {tuple(whole[i : i + k]) for i in range(len(whole) - k + 1)}
    return len(mine & theirs) / len(mine) if mine else 0.0


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The question whole or nearly, once or repeated, and nothing more."""
    for wrapper in WRAPPERS:
        if answer[: len(wrapper)] == wrapper != question[: len(wrapper)]:
            answer = answer[len(wrapper) :]
    while len(answer) > 1 and answer[-1] in ("a", "answer", "q") and (not question or question[-1] != answer[-1]):
        answer = answer[:-1]
    while len(answer) > 1 and answer[0] in ("q", "question", "a", "answer", "note") and (not question or question[0] != answer[0]):
        answer = answer[1:]
    if len(question) < 3 or len(answer) < 3:
        return False
    extra = len(answer) - sum(w in question for w in answer)
    if extra > 0.1 * len(question) + 1 or (Counter(question) & Counter(answer)).total() < 0.8 * len(question):  # bounds of what follows
        return False
    if common_subsequence(question, answer) < 0.8 * len(question):
        return False
    inside = containment(answer, question)
    return inside >= 0.6 and (len(answer) <= 1.2 * len(question) + 1 or inside >= 0.75)


TEMPLATES = [(words, frozenset(words), max(len(words) - len(words) // 6, 3)) for t in REFUSALS if (words := [w for w in tokens(t) if w != "*"])]


def follows(frame: tuple[frozenset[str], ...], answer: list[str]) -> bool:
    """Whether words of the slots of a frame stand in the answer in order, within SPAN words."""
    for i, w in enumerate(answer):
        if w in frame[0]:
            at = 1
            for x in answer[i + 1 : i + SPAN]:
                at += at < len(frame) and x in frame[at]
            if at == len(frame):
                return True
    return False


def is_refusal(answer: list[str]) -> bool:
    """Whether any stretch of the answer aligns with a refusal."""
    said = frozenset(answer)
    for words, kinds, least in TEMPLATES:
        if len(kinds & said) < min(least, len(kinds) - len(kinds) // 6):
            continue
        wide = 2 * len(words) + 14
        for i, w in enumerate(answer):
            if w in kinds:
                stretch = answer[i : i + wide]
                if common_subsequence(words, stretch) >= least and containment(words, stretch, 2) >= 0.7:
                    return True
    return any(all(slot & said for slot in frame) and follows(frame, answer) for frame in FRAMES)


def is_cut(text: str) -> bool:
    """Whether a text stops before its end. Amounts and periods, which begin with a number, yes or no, and
    other answers of up to three words are whole."""
    t = text.strip().rstrip("\"'”»*_` ").strip()
    words = tokens(t)
    if len(words) > 1 and (t.endswith(("...", "…", ",", "-", "–", "(", "[", ":", ";", "/")) or words[-1] in OPEN_END and not t.endswith((".", "!", "?", "।"))):
        return True
    if t.endswith((".", "!", "?", "।", "॥", ")", "]", "}", "%")):
        return t.count("(") > t.count(")")
    return not (len(words) <= 3 or AMOUNT.match(t) or SHARE.match(t) or t[:1].isdigit() or words[0] in COUNTS)


def output_cut(raw: str | None) -> bool:
    """Whether a raw output is a JSON object that was opened and never closed."""
    if raw is None:
        return False
    t = re.sub(r"^\s*```(?:json)?\s*", "", raw.strip())
    if not t.startswith("{"):
        return False
    t = re.sub(r"\s*`+\s*$", "", t)
    try:
        json.loads(t)
    except ValueError:
        depth, quoted, escaped = 0, False, False
        for c in t:
            if escaped:
                escaped = False
            elif c == "\\" and quoted:
                escaped = True
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "{") - (c == "}")
        return quoted or depth > 0
    return False


Profiles = dict[str, tuple[dict[str, float], float]]


def profiles(labelled: DataFrame, sample: int = LABELLED) -> Profiles:
    """Of each language its sequences of three letters with the logarithms of their shares, and that of
    one not seen. labelled: lang, text; a language is its first two letters, `und` is none. Single wrong
    labels weigh little in the counts. About `sample` rows are counted, those with the least hashes of
    their texts, and GRAMS sequences a language kept, so what comes to the driver is bounded."""
    lang = F.lower(F.substring("lang", 1, 2))
    known = labelled.where("lang is not null and lang <> 'und' and text is not null").where(lang.isin(*SPOKEN))
    share = min(1.0, sample / max(1, known.count()))
    rows = known.where((F.xxhash64("text") / 2.0**64 + 0.5) <= share).select(lang.alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for of, t in zip(*(c.to_pylist() for c in batch.columns)):
                seen.update((of, g) for g in grams(t))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.slice(F.sort_array(F.collect_list(F.struct("n", "gram")), False), 1, GRAMS).alias("top")).collect()
    return {r["lang"]: ({x["gram"]: math.log((x["n"] + 1) / (r["all"] + GRAMS)) for x in r["top"]}, math.log(1 / (r["all"] + GRAMS))) for r in best}


def grams(text: str) -> list[str]:
    """All sequences of three letters, words set apart by one blank."""
    t = " " + " ".join(w for w in tokens(text) if not w[0].isdigit()) + " "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def by_profile(text: str, known: Profiles) -> str | None:
    """The language whose profile explains the letters best, if by far and over enough of them."""
    found = grams(text)
    if len(found) < 20 or len(known) < 2:
        return None
    score = sorted(((sum(p.get(g, none) for g in found) / len(found), lang) for lang, (p, none) in known.items()), reverse=True)
    return score[0][1] if score[0][0] - score[1][0] >= 1.0 else None


def language(text: str, known: Profiles | None = None) -> str | None:
    """The language most of the words speak for, else that of the letters, or None: a bare amount, a name, too little text."""
    words = tokens(text)
    deva = sum("ऀ" <= w[0] <= "ॿ" for w in words)
    if deva and 2 * deva >= len([w for w in words if not w.isdigit()]):
        return "hi"
    votes = dict.fromkeys(SPOKEN, 0.0)
    for w in words:
        if w.startswith(("l'", "d'", "qu'")):
            votes["fr"] += 1
        for k in BY_WORD.get(w, ()):
            votes[k] += 1 / len(BY_WORD[w])
    best, second = sorted(votes.values(), reverse=True)[:2]
    if best < 0.9 or best < 1.5 * second or best < 0.1 * len(words):
        return by_profile(text, known) if known else None
    return max(votes, key=votes.__getitem__)


def defect(question: str | None, answer: str | None, raw: str | None, known: Profiles | None = None) -> str | None:
    text = common_form(answer or "").strip()
    said = tokens(text)
    if not said or " ".join(said).strip("'") in NO_ANSWER or re.fullmatch(r"(?i)\W*n\s*/\s*a\W*", text):
        return "empty"
    asked = common_form(question or "")
    if is_copy(tokens(asked), said):
        return "copied_question"
    if is_refusal(said):
        return "refusal"
    if is_cut(text) or output_cut(raw):
        return "truncated"
    if AMOUNT.match(text):
        return None
    ours, theirs = language(asked, known), language(text, known)
    return "wrong_language" if ours and theirs and ours != theirs else None


def defective_pairs(questions: DataFrame, answers: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(answer_id, defect): one row per defective answer that is not declined.

    questions has id and question, answers has answer_id, id, answer, declined, gen_raw; labelled, if
    given, has lang and text. A null `declined` is not a decline. An answer without a question is
    judged on its own, by all but the question. Repeated rows count once; of rows that differ under one
    answer_id or question id the greatest by contents is taken. A null answer_id takes no part."""
    sent = questions.sparkSession.sparkContext.broadcast(profiles(labelled) if labelled is not None else {})  # GRAMS a language

    @F.pandas_udf("string")
    def judge(question: pd.Series, answer: pd.Series, raw: pd.Series) -> pd.Series:
        none = lambda x: x if isinstance(x, str) else None
        known = sent.value
        return pd.Series([defect(none(q), none(a), none(r), known) for q, a, r in zip(question, answer, raw)], dtype=object)

    asked = questions.where("id is not null").groupBy("id").agg(F.max("question").alias("question"))
    given = answers.where("answer_id is not null and not coalesce(declined, false)").select("answer_id", F.struct(F.coalesce("id", F.lit("")).alias("id"), "answer", "gen_raw").alias("r")).groupBy("answer_id").agg(F.max("r").alias("r"))
    pairs = given.select("answer_id", "r.*").join(asked, "id", "left")
    return pairs.select("answer_id", judge("question", "answer", "gen_raw").alias("defect")).where("defect is not null")
