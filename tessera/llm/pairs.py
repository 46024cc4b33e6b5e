"""Broken prompt and response pairs: each defective pair with its kind of defect.

Shortened versions are found by sorting the answers by text and comparing neighbours' common prefixes; length-limit
spikes, structures left open and closing words tell the other cut answers (module truncation); copy, refusal and
language are rules on one pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_table
from .language import language, rules_out
from .normal import plain
from .truncation import ENDING, ENDING_NAMES, WordCounts, added, ending_columns, judged, shortened, word_columns

# Stand-ins for an answer.
PLACEHOLDERS = frozenset("none null nil nan undefined na n/a tbd todo empty missing void blank noanswer noresponse nooutput".split())
SHELL = re.compile(r"(?:answer|response|output|reply|assistant|result|completion|text|prompt|instruction)\s*:?")
TOKEN = re.compile(r"[一-鿿]|[^\W_]+")
LEAD = re.compile(r"^\W*(?:(?:sure|certainly|of course|okay|ok|all right|yes)\b[!,. :]*)?\W*(?:(?:you ask|you asked|question|instruction|prompt|q|task|user|answer|response|here is|here you go|repeat)\b\s*[:.,]\s*)?", re.I)



def joined(lines: str) -> re.Pattern:
    """One pattern for lower-case text of the lines, each of which goes on where the one before stops."""
    return re.compile("".join(x.strip() for x in lines.splitlines()))


# The grammar of declining. A refusal is a negated ability, will or permission with an act of answering, a verb
# of declining with its speaker, or a request that is not met; an excuse is regret, thanks for understanding, or a ground.
REFUSE = joined(
    r"""^(?:(?=.*\b(?:i|we|me|us|my|our|assistant|model)\b).*?|\W*(?:sorry\W+)?)\b(?:can(?:no|')t|can not|could not|couldn't|won't|will not|would not|wouldn't|do not|don't|unable|not able|not in a position|must not|may not|not allowed|not permitted|not let|not right)\b.{0,60}\b(?:help|assist|answer|discuss|provide|give|write|talk|speak|continue|produce|comment|go into|take (?:part|a position|sides)|do (?:it|that|this|so)|comply|fulfil|engage|support|respond|reply|share|say|offer|process|create|generate|advise|touch|covered|me)\b
    |\b(?:i|we)\b.{0,25}\b(?:declin\w*|refus\w*|(?:must|have to|will) pass|abstain|(?:would )?rather not|prefer|choose not|(?:am|are) not comfortable|keep away|leave (?:it|this|that) (?:alone|out)|(?:have been|was) asked to)\b
    |\b(?:rather not|not comfortable|keep away from|must pass|have to decline|prefer to leave|prefer a different|no comment|sorry,? no|not something (?:i|we)|against (?:my|our)|outside (?:of )?(?:my|our|what (?:i|we)))\b
    |\b(?:request|question)\s+(?:(?:is|was|has|had|been|must|will|be)\s+)*(?:declined|denied|refused)\b|\b(?:is|are|was|were|has been)\b.{0,12}\b(?:better left|left (?:unsaid|alone))\b|\b(?:must|has to|have to|needs to) be (?:declined|denied|refused|turned down)\b|\b(?:raises?|poses?|carries) too (?:many|much|great)\b
    |\b(?:can(?:not|'t)|could not|will not|should not|must not) be (?:covered|processed|answered|discussed|fulfilled|told|given|shared|said)\b
    |\b(?:better|best)\b.{0,80}\b(?:unsaid|unexplained|unanswered|untold|somebody else|someone else)\b|\bask (?:some(?:body|one) else|another)\b|\bno part of\b.{0,80}\bcovered\b|\bnobody should\b
    |^as an? (?:ai|assistant|language model)\b.{0,30}\b(?:don't|do not|can't|cannot|won't)
    |no puedo|no podemos|no me es posible|prefiero no|no está permitido|ne peux pas|ne pouvons pas|impossible d'aider|il m'est impossible|préfère ne pas|kann ich (?:\w+ )?nicht|ich kann (?:\w+ ){0,2}nicht|darf ich nicht|nichts sagen|nicht helfen|möchte ich (?:lieber )?nicht|non posso|non possiamo|non mi è possibile|preferisco non|kan ik (?:niet|geen)|mag ik|liever niet|praat ik liever|не могу|не можем|нельзя|не хочу|предпочёл бы не|предпочитаю не|不能|无法|不方便|拒绝"""
)
PARDON = joined(
    r"""^(?:i'm sorry|i am sorry|sorry|apologies|my apologies|unfortunately|with regret|i regret|lo siento|por desgracia|désolé|leider|es tut mir leid|mi dispiace|purtroppo|het spijt me|helaas|извините|к сожалению|很抱歉|对不起|抱歉)[.!,。]?$
    |\bthank you for (?:your (?:patience|understanding)|understanding)\b|\bhope you (?:can )?understand\b|\blet us (?:leave|talk)\b|\btoo (?:delicate|sensitive|dangerous|personal)\b|\bwish to avoid\b|\b(?:something else|another topic|a different (?:topic|question))\b|\bask me (?:about|anything)\b|\bsilence\b
    |\b(?:could|might|may)\b.{0,30}\b(?:harm|offend|hurt|be seen|be misused)\b|\bqualified professional\b|\bseen as an endorsement\b|\bleft out by any reply\b|\bwell-being\b|\bnot be (?:responsible|appropriate)\b|\bso i will not\b|\bbest that\b.{0,80}\b(?:silent|not|nothing|alone)\b|\bsafer\b|verständnis|entschuldig|gracias|merci|grazie|scusi|begrip|谅解|谢谢|поним|спасибо"""
)
LEADUP = re.compile(r"^(?:you (?:would like|ask|asked|want)\b.*|(?:sure|of course|certainly|okay|well)\W*|thank you for (?:asking|your question)\W*|(?:that is )?an? (?:interesting|good|great) question\W*)$", re.I)
SENTENCE = re.compile(r"""(?<=[.!?])[”"'’)*_]*\s+|(?<=[。！？])\s*|\n+""")
QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]')
ASKED = re.compile(r"\b(?:translat\w*|translation)\b|\b(?:in|into|to|auf|en|in het)\s+(?:french|spanish|italian|german|dutch|russian|chinese|english|portuguese|japanese|mandarin|latin)\b|übersetz|traduis|traduc|traduci|vertaal|перевед|翻译", re.I)


def is_empty(text: str | None) -> bool:
    """Null, blank, or nothing but a placeholder or an empty shell (fence, tags, quotes, label), however much white space and markup is around it."""
    if text is None:
        return True
    t = re.sub(r"</?[A-Za-z][\w-]*/?>|```\w*", " ", text) if "<" in text or "```" in text else text
    t = " ".join(t.split()).lower()
    if not any(c.isalnum() for c in t):
        return True
    core = t.strip(" *_#>[](){}\"'`")
    if len(core) > 40:  # longer than every placeholder and shell
        return len(bare := re.sub(r"[^\w/]", "", core)) <= 12 and bare in PLACEHOLDERS
    return re.sub(r"[^\w/]", "", t) in PLACEHOLDERS or bool(SHELL.fullmatch(core)) and ":" in t


def repeats(q: list[str], t: list[str], least: float = 0.66) -> bool:
    """Whether t is q, once or more, with at least that share of their words matched in order.

    Words that can't match are ruled out by counting before anything is compared; the copies are then matched one after
    the other, so the work grows with the length of t and not with its square.
    """
    k = max(1, round(len(t) / len(q)))
    both = len(t) + k * len(q)
    if 2 * sum(map(set(q).__contains__, t)) <= least * both:
        return False
    have, want = Counter(t), Counter(q)
    if 2 * sum(min(n, k * want[w]) for w, n in have.items() if w in want) <= least * both:
        return False
    if k <= 2:
        return SequenceMatcher(None, q * k, t, autojunk=False).ratio() > least
    same = at = 0
    while at < len(t):
        window = t[at : at + len(q) + max(4, len(q) // 4)]
        found = [m for m in SequenceMatcher(None, q, window, autojunk=False).get_matching_blocks() if m.size]
        same += sum(m.size for m in found)
        at += found[-1].b + found[-1].size if found else len(window)
    return 2 * same > least * both


def is_copy(question: str, answer: str) -> bool:
    """The answer is the question again, once or more, exactly or slightly changed. Words after a colon, given back without what stands before it, are the text that the question asks to rework."""
    q, a = TOKEN.findall(plain(question)), TOKEN.findall(plain(answer))
    if not q or not a or len(a) < 0.5 * len(q):
        return False
    head, colon, payload = question.partition(":")
    if colon and payload.strip():
        h = set(TOKEN.findall(plain(head)))
        if len(h) <= 10 and sum(x in a for x in h) < 0.6 * len(h):
            return False
    if repeats(q, a):
        return True
    b = TOKEN.findall(plain(LEAD.sub("", answer)))
    return bool(b) and b != a and repeats(q, b)


def sentences(text: str) -> Iterator[str]:
    at = 0
    for m in SENTENCE.finditer(text):
        if s := text[at : m.start()].strip(" \t*_>#"):
            yield s
        at = m.end()
    if s := text[at:].strip(" \t*_>#"):
        yield s


def is_refusal(answer: str) -> bool:
    """Every sentence declines, excuses or leads up to that, and one declines outside quotes. Texts of any length are read until a sentence says something else."""
    declined = False
    for s in sentences(answer.replace("’", "'").lower()):
        if not any(c.isalnum() for c in s):
            continue
        bare = QUOTED.sub(" ", s) if s.count('"') >= 2 or "“" in s or "«" in s else s
        if REFUSE.search(bare) and not re.search(r"\bbut here\b|\bhere is\b|\bhowever, here\b", bare):
            declined = True
        elif not (PARDON.search(bare) or LEADUP.match(bare)):
            return False
    return declined


def foreign(question: str, answer: str) -> bool:
    """More than a quoted sentence of the answer is in a language that the question is not in, and did not ask for."""
    if ASKED.search(question):
        return False
    own = language(question)
    ruled: dict[str, bool] = {}

    def other(text: str) -> bool:
        code = language(text)
        if code is None or code == own:
            return False
        if code not in ruled:
            ruled[code] = own is not None or rules_out(question, code)
        return ruled[code]

    quoted = sum(map(other, QUOTED.findall(answer)))
    bare = [x for x in sentences(QUOTED.sub(" ", answer)) if any(c.isalnum() for c in x)]
    strange = sum(other(s) and len(TOKEN.findall(s)) >= 4 for s in bare)
    return strange >= 2 or (strange == 1 and 2 * strange >= len(bare)) or quoted >= 2


def rule(question: str | None, answer: str | None, both: bool) -> str | None:
    """The defect that a pair shows by itself; both: an empty question counts too."""
    if is_empty(answer) or (both and is_empty(question)):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if question and is_copy(question, answer):
        return "copy"
    if question and foreign(question, answer):
        return "language"
    return None


def pair_rows(goody: DataFrame, eval_results: DataFrame, processed_rows: DataFrame) -> DataFrame:
    """id, pair_table, pair_id, question, answer, both of the three tables."""
    part = lambda df, name, key, q, a: df.select(F.lit(name).alias("pair_table"), F.col(key).cast("long").alias("pair_id"), F.col(q).alias("question"), F.col(a).alias("answer"))
    rows = part(goody, "goody", "row_id", "instruction", "response").unionByName(part(eval_results, "eval_results", "result_id", "prompt", "model_response")).unionByName(part(processed_rows, "processed_rows", "row_id", "prompt", "text"))
    return rows.withColumn("id", F.concat_ws(":", "pair_table", F.col("pair_id").cast("string"))).withColumn("both", F.col("pair_table") == "processed_rows")


#: The order in which a pair's defects count.
RANK = ("empty", "refusal", "copy", "language", "truncated")


def find_defects(rows: DataFrame, flush: int = 200_000) -> DataFrame:
    """pair_table, pair_id, defect for every defective pair. rows: as of pair_rows().

    One defect a pair, the first of: empty, refusal, copy, language, truncated. A pair whose question is null can only be
    empty, refusal or truncated. Exact repeats of a row are one case, repeated pairs under other ids are each named; an
    empty table gives no row. One scan gives the rules' verdicts, the endings and the word counts; of the texts only the
    distinct answers are shuffled, to be sorted.
    """
    names = ["id", "pair_table", "pair_id", "defect", *ENDING_NAMES, "place", "n", "closed"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts()
        for b in batches:
            q, a, both = (b.column(k).to_pylist() for k in (3, 4, 5))
            for t in a:
                if t:
                    counts.add(t)
            none = [pa.nulls(len(a), k) for k in kinds[-3:]]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array([rule(*x) for x in zip(q, a, both)], pa.string()), *ending_columns(a), *none], schema=schema)
            if len(counts) > flush:
                yield word_columns(counts, schema)
        yield word_columns(counts, schema)

    rows = rows.select("id", "pair_table", "pair_id", "question", "answer", "both")
    out = ENDING.replace("id string,", "id string, pair_table string, pair_id long, defect string,") + ", place string, n long, closed long"
    all_ = cut_table(rows.mapInArrow(run, out))
    rules = cut_table(all_.filter("place is null").select("id", "pair_table", "pair_id", "defect", *ENDING_NAMES).dropDuplicates(["id", "hash", "defect"]))
    answers = rows.select("id", F.col("answer").alias("text")).filter("text is not null")
    ends = rules.filter("defect is null and kind <> 'none'").select("id", *ENDING_NAMES)
    cuts = judged(ends, added(all_)).filter("cut").select("id").union(shortened(answers)).distinct().select("id", F.lit("truncated").alias("cut_off"))
    named = rules.select("id", "pair_table", "pair_id", "defect").join(cuts, "id", "left").withColumn("defect", F.coalesce("defect", "cut_off")).filter("defect is not null")
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("defect"))
    return named.groupBy("pair_table", "pair_id").agg(F.min(F.struct(rank, "defect"))["defect"].alias("defect"))
