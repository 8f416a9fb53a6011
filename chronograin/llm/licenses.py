"""License scans by ordered signature rules, in DataFrame functions only.

A text counts as words (letters and digits, A-Z lower-cased). Base phrases are looked up word by word. On top of
them, hundreds of rules are run over the normalized text: every license has a pattern of its name and one
of its short names, each bare and in several wordings that grant it ("licensed under the ..", "SPDX-License-Identifier
..", ..). They are ordered: earlier wordings and licenses have priority.

A text is first tested for any keyword at all in one pass, so most texts stop there; a rule is tried only
where its own keyword occurs. Detections are intervals of the normalized text. One that lies within
another is suppressed, and of equal intervals the one of the highest priority stays; what remains gives the labels.
Everything about a text is computed within its row: nothing is shuffled.

Defined results: NULL and empty texts have no words and no labels; places count each occurrence; a
repeated row is scanned each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.llm.common import settle

WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

# Base phrases and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# label, pattern of the name, pattern of the short name; most specific first
LICENSES = [
    ("agpl-3.0", "gnu affero general public license (?:version |v ?)?3(?: 0)?", "agpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "gnu (?:lesser|library) general public license (?:version |v ?)?2 1", "lgpl ?v?2 1"),
    ("lgpl-3.0", "gnu lesser general public license (?:version |v ?)?3(?: 0)?", "lgpl ?v?3(?: 0)?"),
    ("gpl-2.0", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)?", "gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?", "gpl ?v?3(?: 0)?"),
    ("agpl", "(?:gnu )?affero general public license", "gnu agpl"),
    ("lgpl", "gnu (?:lesser|library) general public license", "gnu lgpl"),
    ("gfdl", "gnu free documentation license(?: version 1 [123])?", "gnu fdl licen[cs]ed?"),
    ("gpl", "(?:gnu )?general public license", "gnu gpl"),
    ("apache-2.0", "apache (?:software )?license (?:version |v ?)?2(?: 0)?", "apache 2(?: 0)?"),
    ("apache-1.1", "apache (?:software )?license (?:version |v ?)?1 1", "apache 1 1"),
    ("apache-1.0", "apache (?:software )?license (?:version |v ?)?1 0", "apache 1 0"),
    ("mit-0", "mit no attribution license", "mit 0 licen[cs]ed?"),
    ("mit", "mit license", "mit licen[cs]ed"),
    ("x11", "x11 license", "mit x11 licen[cs]ed"),
    ("expat", "expat license", "expat mit license"),
    ("bsd-4-clause", "(?:original|4 clause|four clause) bsd license", "bsd 4 clause(?: license)?"),
    ("bsd-3-clause", "(?:new|modified|revised|3 clause|three clause) bsd license", "bsd 3 clause(?: license)?"),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd license", "bsd 2 clause(?: license)?"),
    ("0bsd", "(?:zero clause|0 clause) bsd license", "0bsd(?: license)?"),
    ("bsd", "(?:berkeley software distribution|bsd(?: style)?) license", "bsd licen[cs]ed"),
    ("isc", "isc license", "isc licen[cs]ed"),
    ("cc-by-nc-nd-4.0", "creative commons attribution non ?commercial no ?deriv(?:ative|ativ)e?s? 4 0(?: international)?", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "creative commons attribution non ?commercial share ?alike 4 0(?: international)?", "cc by nc sa 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution non ?commercial 4 0(?: international)?", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "creative commons attribution no ?deriv(?:ative)?s? 4 0(?: international)?", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution share ?alike 4 0(?: international)?", "cc by sa 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0(?: international)?", "cc by 4 0"),
    ("cc-by-nc-nd-3.0", "creative commons attribution non ?commercial no ?deriv(?:ative)?s? 3 0(?: unported)?", "cc by nc nd 3 0"),
    ("cc-by-nc-sa-3.0", "creative commons attribution non ?commercial share ?alike 3 0(?: unported)?", "cc by nc sa 3 0"),
    ("cc-by-nc-3.0", "creative commons attribution non ?commercial 3 0(?: unported)?", "cc by nc 3 0"),
    ("cc-by-sa-3.0", "creative commons attribution share ?alike 3 0(?: unported)?", "cc by sa 3 0"),
    ("cc-by-3.0", "creative commons attribution 3 0(?: unported)?", "cc by 3 0"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "cc by nc"),
    ("cc-by-sa", "creative commons attribution share ?alike", "cc by sa"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?", "cc by nd"),
    ("cc0-1.0", "creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", "cc0(?: 1 0)?"),
    ("cc-by", "creative commons attribution", "cc by"),
    ("cc", "creative commons license", "creative commons licen[cs]ed"),
    ("mpl-2.0", "mozilla public license (?:version |v ?)?2 0", "mpl 2 0 licen[cs]ed?"),
    ("mpl-1.1", "mozilla public license (?:version |v ?)?1 1", "mpl 1 1 licen[cs]ed?"),
    ("mpl", "mozilla public license", "mpl licen[cs]ed?"),
    ("epl-2.0", "eclipse public license (?:version |v ?)?2 0", "epl 2 0 licen[cs]ed?"),
    ("epl-1.0", "eclipse public license (?:version |v ?)?1 0", "epl 1 0 licen[cs]ed?"),
    ("epl", "eclipse public license", "epl licen[cs]ed?"),
    ("edl-1.0", "eclipse distribution license(?: 1 0)?", "edl licen[cs]ed?"),
    ("cddl-1.0", "common development and distribution license(?: 1 [01])?", "cddl licen[cs]ed?"),
    ("cpl-1.0", "common public license(?: 1 0)?", "cpl licen[cs]ed?"),
    ("eupl-1.2", "european union public licen[cs]e(?: 1 [12])?", "eupl licen[cs]ed?"),
    ("artistic-2.0", "artistic license 2 0", "artistic 2 0 licen[cs]ed"),
    ("artistic", "(?:perl )?artistic license", "artistic licen[cs]ed"),
    ("bsl-1.0", "boost software license(?: version)?(?: 1 0)?", "boost license"),
    ("bsl-1.1", "business source license(?: 1 1)?", "business source licen[cs]ed"),
    ("zlib", "zlib(?: libpng)? license", "zlib licen[cs]ed"),
    ("libpng", "libpng license(?: version 2)?", "libpng licen[cs]ed"),
    ("unlicense", "(?:the )?unlicense", "unlicense org"),
    ("wtfpl", "do what the f\\w* you want to public license", "wtfpl public license"),
    ("psf-2.0", "python software foundation license(?: version 2)?", "python psf license"),
    ("python-2.0", "python license(?: 2 0)?", "python 2 0 license"),
    ("php-3.01", "php license(?: version)?(?: 3 01?)?", "php licen[cs]ed"),
    ("ruby", "ruby license", "ruby s license"),
    ("openssl", "openssl license", "openssl licen[cs]ed"),
    ("postgresql", "postgresql licen[cs]e", "postgresql licen[cs]ed"),
    ("ofl-1.1", "sil open font license(?: version)?(?: 1 1)?", "open font license"),
    ("odbl-1.0", "open database license(?: 1 0)?", "odbl licen[cs]ed?"),
    ("odc-by-1.0", "open data commons attribution(?: license)?(?: 1 0)?", "odc by licen[cs]ed?"),
    ("pddl-1.0", "public domain dedication and license(?: 1 0)?", "pddl licen[cs]ed?"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain work"),
    ("ncsa", "university of illinois (?:ncsa )?open source license", "ncsa licen[cs]ed?"),
    ("afl-3.0", "academic free license(?: version)?(?: 3 0)?", "afl licen[cs]ed?"),
    ("osl-3.0", "open software license(?: version)?(?: 3 0)?", "osl licen[cs]ed?"),
    ("ms-pl", "microsoft public license", "ms pl licen[cs]ed?"),
    ("ms-rl", "microsoft reciprocal license", "ms rl licen[cs]ed?"),
    ("upl-1.0", "universal permissive license(?: 1 0)?", "upl licen[cs]ed?"),
    ("ecl-2.0", "educational community license(?: version)?(?: 2 0)?", "ecl licen[cs]ed?"),
    ("lppl-1.3c", "latex project public license(?: 1 3c?)?", "lppl licen[cs]ed?"),
    ("qpl-1.0", "q public license(?: 1 0)?", "qt public license"),
    ("vim", "vim license", "vim licen[cs]ed"),
    ("sleepycat", "sleepycat license", "sleepycat licen[cs]ed"),
    ("elastic-2.0", "elastic license(?: 2 0)?", "elastic licen[cs]ed"),
    ("sspl-1.0", "server side public license(?: 1 0)?", "sspl licen[cs]ed?"),
    ("openrail", "(?:open rail|openrail)(?: m)? license", "responsible ai rail license"),
    ("llama", "llama (?:2 |3 )?community license(?: agreement)?", "llama license"),
    ("gutenberg", "(?:full )?project gutenberg license", "gutenberg license"),
    ("proprietary", "proprietary license", "proprietary licen[cs]ed"),
    ("all-rights-reserved", "all rights reserved", "some rights reserved"),
]

# wordings around a pattern, in the order of their priority, with what a detection is worth
WORDINGS = [
    ("spdx license identifier (?:{})", 1.0),
    ("(?:licen[cs]ed|released|distributed|published|made available|provided|available|covered) under (?:the )?(?:terms (?:of )?(?:the )?)?(?:{})", 0.95),
    ("(?:subject to|governed by|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{})", 0.85),
    ("(?:{})", 0.7),
]
BASE_SCORE = 0.5

_FOUND = "array<struct<start:int,back:int,priority:int,label:string,score:double>>"
_RULES = "array<struct<keyword:string,core:string,rules:array<struct<priority:int,pattern:string,label:string,score:double>>>>"
_KEPT = "struct<upto:int,labels:array<string>,score:double>"


# words that say too little to be the keyword of a rule
GENERIC = {"license", "public license", "4 0", "3 0", "1 0", "2 0"}
# every keyword holds one of these, which a text must hold to be looked at closely
ROOTS = ("licen", "gpl", "cc0", "commons", "cc by", "apache", "bsd", "public domain", "reserved", "zlib", "illinois")


def keyword(pattern: str) -> str:
    """The longest piece that every match of the pattern holds literally."""
    gap = "\0"
    previous = None
    while previous != pattern:
        previous, pattern = pattern, re.sub(r"\((?:\?:)?[^()]*\)\??", gap, pattern)
    pattern = re.sub(r"\[[^]]*\]\??|\\w\*?|.\?", gap, pattern)
    pieces = [piece.strip() for piece in pattern.split(gap)]
    return max((x for x in pieces if x), key=lambda x: (x not in GENERIC, len(x)))


def rules() -> list[tuple[str, int, str, str, float]]:
    """(pattern of the license, priority, pattern of the rule, label, score), in order."""
    out = []
    for wording, score in WORDINGS:
        for label, *patterns in LICENSES:
            for pattern in patterns:
                out.append((pattern, len(out), f"(?<= ){wording.format(pattern)}(?= )", label, score))
    return out


def _gate(text: Column) -> Column:
    """Whether the text holds a root of any keyword; lower() also folds other letters, which only lets more in."""
    low = F.lower(text)
    found = F.lit(False)
    for root in ROOTS:
        found = found | (low.rlike(root.replace(" ", _GAP)) if " " in root else F.contains(low, F.lit(root)))
    return found


def _rule_table() -> Column:
    """Patterns with their keyword and rules, as one constant."""
    by_pattern: dict[str, list[dict]] = {}
    for core, priority, pattern, label, score in rules():
        rule = {"priority": priority, "pattern": pattern, "label": label, "score": score}
        by_pattern.setdefault(core, []).append(rule)
    text = json.dumps([{"keyword": keyword(c), "core": c, "rules": r} for c, r in by_pattern.items()])
    return F.from_json(F.lit(text), _RULES)


def _word_count(text: Column) -> Column:
    """Pieces between the gaps, without the empty ones that a gap at either end leaves."""
    pieces = F.split(text, _GAP, -1)
    n = F.size(pieces)
    first, last = F.get(pieces, F.lit(0)) == "", F.get(pieces, n - 1) == ""
    return n - F.when(first, 1).otherwise(0) - F.when(last & (n > 1), 1).otherwise(0)


def _places(words: Column, phrase: str) -> Column:
    """Positions at which the words of the phrase stand."""
    wanted = phrase.split()
    last = F.size(words) - len(wanted)

    def stands(i: Column) -> Column:
        same = F.get(words, i) == wanted[0]
        for k, word in enumerate(wanted[1:], 1):
            same = same & (F.get(words, i + k) == word)
        return same

    none = F.expr("cast(array() AS array<int>)")
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(none)


def _intervals(norm: Column, rule: Column) -> Column:
    """All detections of one rule, from the lengths of what it matches and of what lies between."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    between = F.split(norm, rule["pattern"], F.lit(-1))

    def add(acc: Column, k: Column) -> Column:
        start = acc["at"] + F.length(F.get(between, k))
        end = start + F.length(F.get(found, k))
        one = F.struct(start.alias("start"), (-end).alias("back"), rule["priority"], rule["label"], rule["score"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found")).cast(state)

    state = f"struct<at:int,found:{_FOUND}>"
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS {_FOUND})").alias("found")).cast(state)
    steps = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.expr("cast(array() AS array<int>)"))
    return F.aggregate(steps, zero, add)["found"]


def _survivors(found: Column) -> Column:
    """Labels and best score of the detections that lie within no other.

    In the order of (start, longest first, priority), a detection lies within an earlier one exactly if it ends
    no later than the furthest end so far.
    """

    def add(acc: Column, d: Column) -> Column:
        end = -d["back"]
        kept = F.struct(
            end.alias("upto"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"),
            F.greatest(acc["score"], d["score"]).alias("score"),
        ).cast(_KEPT)
        return F.when(end <= acc["upto"], acc).otherwise(kept)

    zero = F.struct(
        F.lit(-1).alias("upto"), F.expr("cast(array() AS array<string>)").alias("labels"), F.lit(0.0).alias("score")
    ).cast(_KEPT)
    return F.aggregate(F.array_sort(found), zero, add)


def _made(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and further columns, made once: later filters and projections are not merged into them."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    settle(docs.sparkSession)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), 0)
    worded = texts.select(
        "doc_id", _word_count(F.col("text")).cast("bigint").alias("n_words"), F.when(_gate(F.col("text")), words).alias("words")
    )
    words, none = F.col("words"), F.expr("cast(array() AS array<string>)")
    places = F.array(*[_places(words, phrase) for phrase in BASE])
    placed = _made(
        worded, ["doc_id", "n_words"],
        norm=F.when(words.isNotNull(), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))),
        places=F.when(words.isNotNull(), places),
    )
    norm = F.col("norm")
    # the keyword first, then the license's own pattern, then its wordings
    named = F.filter(_rule_table(), lambda c: F.contains(norm, c["keyword"]) & F.rlike(norm, c["core"]))
    tried = F.flatten(F.transform(named, lambda c: c["rules"]))
    detected = F.flatten(F.transform(tried, lambda r: _intervals(norm, r)))
    base = F.concat(
        *[
            F.when(F.size(F.get("places", F.lit(i))) > 0, F.array(F.lit(label))).otherwise(none)
            for i, label in enumerate(BASE.values())
        ]
    )
    found = _made(
        placed, ["doc_id", "n_words"], places=F.flatten("places"), base=base,
        kept=F.when(norm.isNotNull(), _survivors(detected)),
    )
    n_base = F.when(F.col("places").isNull(), 0).otherwise(F.size("places"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("kept.labels", none))))
    return found.select(
        "doc_id", "n_words", n_base.cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(n_base > 0, BASE_SCORE).otherwise(0.0), F.coalesce("kept.score", F.lit(0.0))).alias("score"),
    )
