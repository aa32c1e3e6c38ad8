"""Query planning texts: sub-queries, slots and bounded lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotations, what before or after one forbids to answer with it, and how much text on either side is looked at.
QUOTATION = re.compile("[‘“\"]([^’”\"]{2,80})[’”\"]")
FORBIDDEN_BEFORE = re.compile("(?:不要|无需|禁止)(?:直接)?(?:回答|认定|写成|证明)?[^。；]{0,8}$")
FORBIDDEN_AFTER = re.compile("^[^‘’“”\"。；]{0,8}(?:未经证明|不能确定|不代表|并非事实)")
BESIDE = 18
#: Texts of the slots of constraints and quotations.
CONSTRAINTS = ("关系约束", "时间约束", "因果约束")
CONSTRAINT_SLOT, ANSWER_SLOT = "__constraint_slot__ {}：{}", "__answer_slot__ 原文中“{}”对应的事实是什么"
#: Answer shapes and greetings of requests that ask for no fact.
CONVERSATION = ("conversation", "conversational", "chat", "chitchat", "greeting")
EXPLORATION = ("exploratory", "explore", "brainstorm", "discovery")
GREETINGS = ("你好", "您好", "嗨", "哈喽", "hello", "hi", "早上好", "晚安", "谢谢", "感谢")
#: Parts of words that negate or qualify a question.
NEGATED = ("不", "未", "没有", "并非", "not ", "never")
MODAL = ("是否", "可能", "能否", "如果", "应当", "must", "may", "might")
#: Patterns of a clause about something that an earlier clause has yet to find.
FOLLOW_UPS = (
    "(?:谁|哪位|哪个|什么人).{0,100}(?:这位|这名|该(?:对象|实体|主体)|其|此人).{0,80}(?:谁|哪位|哪个|什么|又|身份|名称|别名|化名|代号)",
    "(?:这位|这名|该(?:对象|实体|主体)|他们|她们|它们|其|此人).{0,80}(?:谁|哪位|哪个|什么|名称|别名|化名|代号|又)",
    "(?:已识别|上一跳|前一跳|该候选|此人|上述(?:对象|实体|主体))",
)
#: Two subjects of one predicate, enumerations inside quotation marks, marks of slots, and the texts of split slots.
PAIR = re.compile("([^，。；：！？]{2,12})与([^，。；：！？的]{2,16})的(.{3,})$")
QUOTED_LIST = re.compile("[‘“\"][^’”\"]*、[^’”\"]*[’”\"]")
SLOT_MARKS = ("__constraint_slot__ ", "__answer_slot__ ")
PAIR_SLOTS = ("{}本人直接陈述或表现的{}", "{}直接陈述或被转述的{}")
LIST_SLOT = "{}（独立证据槽，不能由同列另一条件替代）"


def sub_queries(question: str | None, relation: str | None = "", time: str | None = "", cause: str | None = "", most: int = 6) -> list[str]:
    """Slots of a question: its constraints of relation, time and cause, then its quotations, but for those that the words beside them forbid; distinct, and no more quotations once
    there are six."""
    out = [CONSTRAINT_SLOT.format(name, value.strip()) for name, value in zip(CONSTRAINTS, (relation, time, cause)) if value and value.strip()]
    text, quoted = question or "", {}
    for m in QUOTATION.finditer(text):
        before, after = text[max(0, m.start() - BESIDE) : m.start()], text[m.end() : m.end() + BESIDE]
        if m[1].strip() and not FORBIDDEN_BEFORE.search(before) and not FORBIDDEN_AFTER.search(after):
            quoted.setdefault(m[1].strip())
    room = max(1, most - len(out))
    return list(dict.fromkeys([*out, *map(ANSWER_SLOT.format, list(quoted)[:room])]))


def atomic_slots(texts, entities=(), whole: str | None = None, most: int = 40) -> list[str]:
    """Every text, and after it a slot for either subject of a predicate that two share (A与B的...) and for the members of four characters or more of
    a sentence's enumeration (、, up to eight members). The whole question, marked slots and alternatives (还是) stay whole. Distinct, at most forty."""
    lead = "、".join(entities[:4]) + "：" if entities else ""
    out: dict[str, None] = {}
    for text in ((t or "").strip() for t in texts):
        slots = [text]
        if text != whole and not text.startswith(SLOT_MARKS) and "还是" not in text:
            if two := PAIR.match(text):
                slots += [PAIR_SLOTS[0].format(two[1], two[3]), PAIR_SLOTS[1].format(two[2], two[3])]
            for sentence in re.split("[。；\n]", text):
                members = [] if QUOTED_LIST.search(sentence) else [m.strip() for m in sentence.split("、")]
                enough = [m for m in members if len(m) >= 4]
                if len(enough) >= 2 and len(members) <= 8:
                    slots += [lead + LIST_SLOT.format(m) for m in enough]
        out |= dict.fromkeys(x for x in slots if x)
    return list(out)[:most]


def bounded_queries(queries, most: int) -> list[str]:
    """Distinct queries that are not blank, in their order, at most so many (0: all): the first and all slots stay, and of the room that is left two thirds go to the first of the others
    and one third to the last."""
    own = list(dict.fromkeys(q.strip() for q in queries if q and q.strip()))
    if most <= 0 or len(own) <= most:
        return own
    fixed = [k for k, q in enumerate(own) if k == 0 or q.startswith(SLOT_MARKS)]
    others = [k for k in range(len(own)) if k not in set(fixed)]
    room = max(0, most - len(fixed))
    front = min(len(others), (2 * room + 2) // 3)
    back = min(len(others), room) - front
    kept = fixed + others[:front] + (others[-back:] if back > 0 else [])
    return [own[k] for k in sorted(kept)][:most]


def _folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _holds_any(text: Column, parts) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))


def is_follow_up(text: Column) -> Column:
    """Whether a question (with its sub-queries and relation, joined by blanks) has a clause about the unknown answer of an earlier one; null: no."""
    return F.coalesce(text.rlike("(?d)" + "|".join(FOLLOW_UPS)), F.lit(False))


def request_mode(question: Column, shape: Column | None = None) -> Column:
    """conversational, exploratory or factual: by the shape of the answer wished for, then by greetings, which fill the whole question."""
    wish = F.regexp_replace(_folded(F.lit("") if shape is None else shape), r"(?U)^\s+|\s+$", "")
    compact = F.regexp_replace(_folded(question), r"(?U)\s+", "")
    return F.when(wish.isin(*EXPLORATION), "exploratory").when(wish.isin(*CONVERSATION) | compact.isin(*GREETINGS), "conversational").otherwise("factual")


def negation(question: Column) -> Column:
    return F.when(_holds_any(_folded(question), NEGATED), "explicit_negation").otherwise("")


def modality(question: Column) -> Column:
    return F.when(_holds_any(_folded(question), MODAL), "modal_or_conditional").otherwise("")
