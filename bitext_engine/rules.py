"""Pattern tables as data. Patterns are written for java.util.regex; those without
lookaround also run unchanged under RE2, apart from the names of the script classes."""

from __future__ import annotations

import re

from bitext_engine.functions.folding import hidden

# fixed values: the five languages handled
LANGUAGES = ("en", "ko", "zh-cn", "zh-tw", "ja")
# languages whose words are set apart by spaces, so that whole words can be matched
SPACED_LANGUAGES = ("en",)

# digits a heading number may be written in: ASCII, full-width, Han
NUMERAL = "[0-9０-９〇零一二三四五六七八九十百千万]+"

# line start, without the multi-line flag, so that both regex engines agree on what a line is
LINE = r"(?:^|\n)[ \t]*"

# fixed values: how each language writes article, clause and item headings.
# PRC numbering is 条/款/项, Taiwan numbering 條/項/款: the same marker may sit on another level.
MARKERS = {
    "en": {
        "article": r"Article[ \t]+([0-9]+)",
        "clause": r"([0-9]+\.[0-9]+)[.)]?[ \t]",
        "item": r"\(([a-z]|[ivx]+|[0-9]+)\)[ \t]",
    },
    "ko": {
        "article": rf"제[ \t]*({NUMERAL})[ \t]*조",
        "clause": rf"제[ \t]*({NUMERAL})[ \t]*항",
        "item": rf"제[ \t]*({NUMERAL})[ \t]*호",
    },
    "zh-cn": {
        "article": rf"第[ \t]*({NUMERAL})[ \t]*条",
        "clause": rf"第[ \t]*({NUMERAL})[ \t]*款",
        "item": rf"第[ \t]*({NUMERAL})[ \t]*项",
    },
    "zh-tw": {
        "article": rf"第[ \t]*({NUMERAL})[ \t]*條",
        "clause": rf"第[ \t]*({NUMERAL})[ \t]*項",
        "item": rf"第[ \t]*({NUMERAL})[ \t]*款",
    },
    "ja": {
        "article": rf"第[ \t]*({NUMERAL})[ \t]*条",
        "clause": rf"第[ \t]*({NUMERAL})[ \t]*項",
        "item": rf"第[ \t]*({NUMERAL})[ \t]*号",
    },
}
LEVELS = {"article": 1, "clause": 2, "item": 3}

# an article heading in any of the languages; group 1, 2 or 3 holds its number
ARTICLE_ANY = rf"(?:Article[ \t]+([0-9]+)|제[ \t]*({NUMERAL})[ \t]*조|第[ \t]*({NUMERAL})[ \t]*[条條])"

LIST_ITEM = r"(?:[-*•]|[0-9]+[.)]|[①-⑳])[ \t]+"
FOOTNOTE = r"\[([0-9]+)\]"
FOOTNOTE_BODY = r"\[([0-9]+)\][ \t]"
MD_HEADING = r"#{1,6}[ \t]"
TABLE_ROW = r"\|[^\n]*\|"
PARAGRAPH = r"(?:^|\n[ \t]*\n)\s*\S"
SENTENCE_END = r"(?:[.!?](?:\[[0-9]+\])*(?:\s|\z)|[。！？])"
SENTENCE_END_SPACED = r"[.!?](?:\[[0-9]+\])*(?:\s|\z)"
SENTENCE_END_CJK = r"[。！？]"
# where a line is cut into sentences: groups 1 and 2 stay with the sentence before
SENTENCE_CUT = r"([.!?](?:\[[0-9]+\])*)\s+|([。！？](?:\[[0-9]+\])*)\s*"

# fixed values: a quoted term followed by the verb that defines it
DEFINED_TERM = {
    "en": r"[\"“]([^\"“”\n]+)[\"”][ \t]+(?:means|shall mean|has the meaning|refers to)",
    "ko": r"[\"“]([^\"“”\n]+)[\"”][ \t]*(?:이란|란|이라 함은|라 함은)",
    "zh-cn": r"[\"“「]([^\"“”「」\n]+)[\"”」][ \t]*(?:是指|系指|指)",
    "zh-tw": r"[\"“「]([^\"“”「」\n]+)[\"”」][ \t]*(?:是指|係指|指)",
    "ja": r"[\"“「]([^\"“”「」\n]+)[\"”」][ \t]*とは",
}

# quoted label in brackets after a party's name: (the "Supplier"), (이하 "공급자")
PARTY_LABEL = r"[(（](?:the[ \t]+|이하[ \t]*|以下[ \t]*(?:简称|簡稱)?[ \t]*)?[\"“「]([^\"“”「」\n]+)[\"”」](?:[ \t]*(?:이라|라|という|といいます)[^)）\n]*)?[)）]"

# function words that tell English from other languages in Latin script
ENGLISH_WORDS = (
    "and", "are", "be", "by", "for", "from", "has", "is", "means", "not",
    "of", "or", "shall", "that", "the", "this", "to", "was", "which", "with",
)

# Han characters whose simplified and traditional forms differ, pair by pair
SIMPLIFIED = "条项约签订当义务责书证权让对应关产业专经营违规则为实现时间"
TRADITIONAL = "條項約簽訂當義務責書證權讓對應關產業專經營違規則為實現時間"

# what may stand between the words of a phrase: blanks, or one line end, which the replacement keeps
GAP = r"([ \t]+|[ \t]*\n[ \t]*)"

# text that looks like an instruction to a reader that is a program:
# (rule, pattern, replacement, hints). The replacement keeps line breaks and pipes, so that
# no structural count changes. Every match contains one of the hints in lower case: a plain
# search for them spares most texts the pattern.
INJECTION_RULES = (
    ("role_marker", r"(?i)((?:^|\n)[ \t]*)(?:system|assistant|developer|user|human)[ \t]*[:：]", "$1‹neutralized›", ("system", "assistant", "developer", "user", "human")),
    ("chat_tag", r"(?i)</?(?:system|assistant|user|instructions?)>", "‹neutralized›", ("system>", "assistant>", "user>", "instruction>", "instructions>")),
    ("template_token", r"<\|[A-Za-z_]+\|>", "‹|neutralized|›", ("<|",)),
    ("ignore_previous", rf"(?i)(?:ignore|disregard|forget){GAP}(?:all{GAP})?(?:the{GAP})?(?:previous|prior|above){GAP}instructions?", "‹neutralized›$1$2$3$4", ("instruction",)),
    ("act_as", rf"(?i)you{GAP}are{GAP}now{GAP}(?:an|a|the)", "‹neutralized›$1$2$3", ("now",)),
    ("reveal_prompt", rf"(?i)(?:reveal|print|show){GAP}(?:your|the){GAP}(?:system{GAP})?prompt", "‹neutralized›$1$2$3", ("prompt",)),
    ("ignore_previous_ko", r"(?:이전|위)의? *(?:모든 *)?지시(?:사항)?를? *무시", "‹neutralized›", ("무시",)),
    ("ignore_previous_zh", r"(?:忽略|无视|無視|忽视|忽視)[ \t]*(?:之前|以上|先前|上述|前面)的?[ \t]*(?:所有|全部)?的?[ \t]*(?:指令|指示|说明|說明)", "‹neutralized›", ("忽略", "无视", "無視", "忽视", "忽視")),
    ("ignore_previous_ja", r"(?:以前|これまで|上記|前)の[ \t]*(?:すべての|全ての)?[ \t]*(?:指示|命令)を?[ \t]*無視", "‹neutralized›", ("無視",)),
)

# words that may stand inside the phrase about earlier instructions
FILLER = "(?:all|any|every|each|of|the|those|these|that|your|my|our|its|other|were|given|so|far)"
_MAYBE = rf"(?:{GAP}{FILLER})?"
# the same rules for text that hides itself, with filler words. A dot follows every line break that stays, as a line that lost
# its words would be blank, and what came behind them could begin with the mark of a list or a table
SANITISER_RULES = tuple(
    (name, hidden(pattern), re.sub(r"(?<!^)(\$[0-9])", r"\1·", replacement), hints)
    for name, pattern, replacement, hints in (
        *[rule for rule in INJECTION_RULES if rule[0] != "ignore_previous"],
        (
            "ignore_previous",
            rf"(?i)(?:ignore|disregard|forget|override){_MAYBE * 4}{GAP}(?:previous|prior|above|earlier|preceding){_MAYBE * 2}{GAP}(?:instructions?|directions?|prompts?)",
            "‹neutralized›" + "".join(f"${k}" for k in range(1, 9)), ("instruction", "direction", "prompt"),
        ),
    )
)

# regional forms: (language, class, pattern)
VARIANT_RULES = (
    ("zh-tw", "foreign", f"[{SIMPLIFIED}]"),
    ("zh-cn", "foreign", f"[{TRADITIONAL}]"),
    ("en", "us", r"(?i)(?:favor|honor|labor|behavior|license|judgment|center|organiz|authoriz|recogniz)"),
    ("en", "uk", r"(?i)(?:favour|honour|labour|behaviour|licence|judgement|centre|organis|authoris|recognis)"),
)

# sentence endings by register: (language, class, pattern on the trimmed sentence)
REGISTER_RULES = (
    ("ko", "legal", r"(?:하여야 한다|할 수 있다|한다|된다|이다|있다|없다|아니한다)[.]?$"),
    ("ko", "polite", r"(?:합니다|습니다|입니다|됩니다|해요|세요)[.]?$"),
    ("ja", "polite", r"(?:です|ます|ません|でした|ました)[。]?$"),
    ("ja", "plain", r"(?:である|とする|する|ない|ならない)[。]?$"),
)

# ways of writing a date
DATE_FORMATS = (
    ("iso", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("en_month_first", r"(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}"),
    ("en_day_first", r"[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}"),
    ("slash", r"[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,4}"),
    ("ko", r"[0-9]{4}년 ?[0-9]{1,2}월 ?[0-9]{1,2}일"),
    ("han", r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日"),
)

# ways of citing a provision
CITATION_FORMATS = (
    ("article", r"Article [0-9]+"),
    ("section", r"(?:Section|§) ?[0-9]+"),
    ("clause", r"Clause [0-9]+"),
    ("ko_article", rf"제 ?{NUMERAL} ?조"),
    ("han_article", rf"第 ?{NUMERAL} ?[条條]"),
)

# glossary origins from the strongest to the weakest
ORIGIN_PRIORITY = {"library": 1, "persistent": 2, "llm": 3, "proposal": 3}

# fixed values: steps of each mode, who runs them, and the relative cost of the mode
MODE_STEPS = {
    "fast": (
        (1, "document_analysis", "none", 0),
        (2, "terminology_setup", "none", 0),
        (3, "single_draft", "translator", 1),
        (4, "structure_glossary_checks", "none", 0),
        (5, "draft_output", "none", 0),
    ),
    "normal": (
        (1, "document_analysis", "none", 0),
        (2, "terminology_setup", "none", 0),
        (3, "translation_pass_a", "translator", 1),
        (4, "translation_pass_b", "translator", 1),
        (5, "comparative_synthesis", "synthesis-editor", 1),
        (6, "structural_verification", "none", 0),
        (7, "quality_gate_output", "none", 0),
    ),
    "hard": (
        (1, "document_analysis", "none", 0),
        (2, "terminology_setup", "none", 0),
        (3, "translation_pass_a", "translator", 1),
        (4, "translation_pass_b", "translator", 1),
        (5, "comparative_synthesis", "synthesis-editor", 1),
        (6, "structural_verification", "none", 0),
        (7, "quality_gate_output", "none", 0),
        (8, "back_translation", "translator", 1),
        (9, "library_comparison", "none", 0),
        (10, "editorial_polish", "editorial-reviewer", 1),
    ),
}
MODE_COST = {"fast": (1.0, 1.0), "normal": (2.5, 2.5), "hard": (5.0, 6.0)}

# checks each gate asks for; the names are ours, the numbers (6 and 10) are fixed
GATE_ITEMS = {
    "fast": ("structure_counts", "glossary_usage"),
    "normal": (
        "structure_counts", "article_numbers", "footnotes",
        "glossary_usage", "defined_terms", "injection",
    ),
    "hard": (
        "structure_counts", "article_numbers", "footnotes",
        "glossary_usage", "defined_terms", "injection",
        "back_translation", "reference_terms", "style_register", "freshness",
    ),
}

# inventory kinds that decide a comparison; the others only warn
DECISIVE_KINDS = ("article", "clause", "item", "list_item", "footnote_mark", "footnote_body")
