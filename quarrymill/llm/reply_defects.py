"""Defects of replies: empty, truncated, refusal, copied, in another language.

A reply is taken out of its wrapping (lead-in, fence, JSON, comment marks) with a stack of open
delimiters: what is still open at the end was cut off. Copies are measured with a suffix automaton of the
prompt that the reply's words traverse; refusals are found by an Aho-Corasick automaton of phrases;
languages vote by script and stopwords. An answer without a full stop whose last word no answer uses
otherwise is cut off.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .split_overlap import latest

#: Share of a reply's words that lie in runs shared with the prompt, and the shortest such run.
COPY_SHARE, COPY_RUN = 0.8, 4

# Word lists and phrases.
_NOTHING = {"", "n/a", "na", "none", "null", "nil", "nothing", "empty", "undefined", "no output", "no answer", "no response", "no content", "no comment", "blank", "tbd"}
_MAIN_KEYS = ("natspec", "summary", "purpose", "comment", "description", "answer", "text", "response", "output", "documentation")
_DANGLING = frozenset(
    "the a an of to and or with from by for in on at is are was not its their which that because if as be when while than into onto under over "
    "between but whose where whenever unless until also each every via per so who may can must should will would has have".split()
)
_STOPWORDS = {
    "en": "the of and to is in for with when by that which its an are if this has be from as on at after before into it only every so whenever not under once would the through rest even",
    "de": "der die das und ist nicht ein eine einen einem einer mit auf für von dem den des wird werden wenn nach vor sich auch im zu zur zum über bei aus oder wurde noch kein keine diese dieser bereits dann gegen",
    "fr": "le la les de d l encore peut doit également tant reste fonction des et est une un dans pour par sur qui que avec ne pas se au aux du ce cette ces il elle été sont plus après avant lors chaque puis sans entre cette si déjà",
    "es": "el los las la y quien también ninguna ningún mientras puede podrá es una un del al se en por para con que su sus no lo como antes después cada si está son fue ya hasta según sin cuando sobre pero este esta función de",
    "it": "il gli della degli delle dello nel nella sul sulla che non è uno viene dal dalla alla allo questo questa anche più dei ed",
    "nl": "het een van niet wordt naar voor met zijn aan door als wanneer bij ook dat deze dit er",
    "pl": "nie się jest dla przez gdy oraz lub od jako który która że tego ten jeśli",
    "pt": "o os as e também nenhuma nenhum enquanto pode poderá é uma um do da dos das ao na no nas nos em por para com que se não são foi está ser já até segundo antes depois cada quando sobre mas este esta função de",
}
_SCRIPT = {
    "ja": re.compile("[\u3041-\u30ff]"), "ko": re.compile("[\u1100-\u11ff\uac00-\ud7af]"), "zh": re.compile("[㐀-鿿]"), "ru": re.compile("[Ѐ-ӿ]"), "el": re.compile("[\u0370-\u03ff]"),
    "he": re.compile("[\u0590-\u05ff]"), "ar": re.compile("[\u0600-\u06ff]"), "hi": re.compile("[\u0900-\u097f]"), "th": re.compile("[\u0e00-\u0e7f]"),
}
_REFUSALS = (
    "i cannot", "i can't", "i can not", "i won't", "i will not", "i'm unable", "i am unable", "i'm not able", "i am not able", "i'd rather not", "i would rather not",
    "i must decline", "i have to decline", "i respectfully decline", "i decline to", "i refuse", "i'm afraid", "i am afraid", "i'm sorry", "i am sorry", "i don't feel comfortable",
    "i do not feel comfortable", "i'm not comfortable", "i am not comfortable", "i have to pass", "i shouldn't", "i should not", "i couldn't", "i could not", "i don't think i",
    "something i have to pass", "outside of what i can", "beyond what i can", "not something i can", "my guidelines", "my instructions do not", "my policy", "my policies",
    "not be appropriate for me", "inappropriate for me", "as an automated assistant", "as an ai", "as a language model", "as an assistant", "no answer can be",
    "no documentation can be provided", "no response can be", "no description can be provided", "request declined", "request denied", "request refused", "than i was given", "declining to answer", "cannot assist with", "can't assist with", "unable to assist", "unable to help",
    "prefer not to answer", "prefer not to respond", "sorry, but", "sorry, no", "sorry - ", "turn down", "beyond my abilities", "beyond my capabilities", "not permitted to answer", "good conscience",
    "against my rules", "assistant does not", "assistant cannot", "unable to provide", "we are unable to help", "we are unable to answer", "we can't help", "we cannot help", "no way i can",
    "unable to comply", "unable to fulfil", "unable to provide an answer", "cannot comply", "can't comply", "cannot help with", "can't help with", "apologies, ", "my apologies",
    "lo siento", "no puedo ", "je ne peux pas", "je refuse", "je suis désolé", "ich kann nicht", "ich kann diese", "darf ich", "es tut mir leid", "não posso ", "desculpe", "я не могу", "извините", "我无法", "我不能", "抱歉", "对不起",
)

# What someone says of themselves who declines: every beginning with every end is a phrase of the automaton.
_SELF = {
    ("i", "i also", "i simply", "unfortunately i", "i really"): ("cannot", "can't", "can not", "won't", "will not", "must refuse", "must decline", "have to refuse", "have to decline", "have to pass", "have to say no", "need to pass", "need to decline", "lack the", "do not provide", "don't provide", "don't have enough", "do not have enough", "do not comment", "don't comment", "do not write", "have been instructed not", "was instructed not", "would prefer not", "would rather not"),
    ("i am", "i'm", "i was"): ("unable", "unwilling", "not able", "not allowed", "not permitted", "not in a position", "not going to", "not willing", "permitted to do", "going to decline", "going to refuse", "going to pass", "going to have to", "declining", "refusing", "forbidden"),
    ("i will", "i'll", "i would", "i'd"): ("have to refuse", "have to decline", "have to pass", "have to say no", "need to pass", "need to decline", "not be able", "prefer not", "rather not"),
}
_SELF_PHRASES = tuple(f"{a} {b}" for heads, ends in _SELF.items() for a in heads for b in ends)

_INVISIBLE = re.compile("[​-‏⁠-⁤﻿­]")
_FENCE = re.compile(r"```[A-Za-z]*[ \t]*\r?\n?")
_MARKS = re.compile(r"^[ \t]*(?:/\*\*?|\*/|\*(?!\*)|///?)[ \t]*|[ \t]*\*/[ \t]*$", re.M)
_TAGS = re.compile(r"(?m)(?:^|(?<=\s))@(?:param[ \t]+\w+|return[ \t]+\w+(?=[ \t]+[A-Z])|[A-Za-z][\w:-]*)")
_TOKEN = re.compile(r"[^\W_](?:\w*)|_\w+")
_IDENT = re.compile(r"`[^`]*`?|\b_?[A-Za-z]+[a-z0-9][A-Z]\w*|\b\w*\d\w*|\b\w*_\w*")
_LETTERS = re.compile(r"[^\W\d_]+")
_JSON_START = re.compile(r'[{\[]\s*(?:["{\[\]}]|\Z)')


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in {*_REFUSALS, *_SELF_PHRASES}:
        a.add_word(p, len(p))
    a.make_automaton()
    return a


@cache
def _votes() -> dict[str, tuple[str, ...]]:
    """Word -> the languages whose stopword it is."""
    lists = {k: set(v.split()) for k, v in _STOPWORDS.items()}
    return {w: tuple(k for k in lists if w in lists[k]) for w in set().union(*lists.values())}


# Who answers, speaking of themselves, and what says that they do not; both in one sentence decline.
_SPEAKER = re.compile(r"\bI(?:'m|'d|'ll|'ve)?\b(?![./_])|\b(?:[Jj]e|[Jj]'|[Ii]ch|[Яя])\b|我")
_DENIAL = re.compile(
    r"(?i)\b(?:not|cannot|\w+n't|unable|unwilling|refus\w*|declin\w*|skip|sorry|apolog\w*|unfortunately|rather|prefer|forbidden|nothing|no|ne|pas|nicht|leider|kein\w*|не|отказ\w*)\b|不|无法|拒"
)
_SENTENCE = re.compile(r"[.!?;\n。！？]+")
_QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"")


def refuses(text: str) -> bool:
    """Whether an answer declines to answer: one of the automaton's phrases, or a sentence in which who answers denies it."""
    text = text.replace("’", "'")
    t = " ".join(text.lower().split())
    if any(end + 1 == n or not t[end - n].isalnum() for end, n in _automaton().iter(t)):
        return True
    if not _SPEAKER.search(text):
        return False
    return any(_SPEAKER.search(x) and _DENIAL.search(x) for x in _SENTENCE.split(_QUOTED.sub(" ", text)))


def language(text: str) -> str | None:
    """The language of a text, None if there is too little to tell."""
    return _spoken(_TAGS.sub(" ", text))


def _spoken(text: str) -> str | None:
    """As ``language``, of a text without tags."""
    text = _IDENT.sub(" ", text)
    words = _LETTERS.findall(text)
    if not text.isascii():
        letters = sum(map(len, words))
        for name, script in _SCRIPT.items():
            n = len(script.findall(text))
            if n > 3 and n * (3 if name in ("zh", "ja", "ko") else 1) >= 0.4 * letters:
                return name
    table = _votes()
    votes = Counter(k for w in words for k in table.get(w.lower(), ())).most_common(2)
    if not votes or votes[0][1] < 2 or len(votes) > 1 and votes[0][1] == votes[1][1]:
        return None
    return votes[0][0]


class SuffixAutomaton:
    """All runs of a sequence's items."""

    def __init__(self, items: Iterable) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for x in items:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, items: list, run: int) -> int:
        """How many items lie in runs of at least ``run`` that the sequence has, too."""
        state = size = total = upto = 0
        for i, x in enumerate(items):
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                size += 1
            if size >= run:
                total += i + 1 - max(upto, i + 1 - size)
                upto = i + 1
        return total


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


@lru_cache(64)
def _runs_of(prompt: str) -> SuffixAutomaton:
    """The prompt's automaton; the replies to one prompt share it."""
    return SuffixAutomaton(words_of(prompt))


def copies(reply: list[str], prompt: str) -> bool:
    """Whether the reply's words are mostly the prompt's, in the prompt's order.

    Words found anywhere in the prompt bound the coverage from above, so the automaton is built only where
    it can matter.
    """
    if not reply or not prompt:
        return False
    low, spare = prompt.lower(), (1 - COPY_SHARE) * len(reply) + 1e-9
    for w in reply:
        if w not in low:
            spare -= 1
            if spare < 0:
                return False
    return _runs_of(prompt).covered(reply, min(COPY_RUN, len(reply))) >= COPY_SHARE * len(reply)


def _open_at_end(text: str) -> bool:
    """Whether JSON from here on leaves a string, object or list open."""
    stack, inside, skip = [], False, False
    for ch in text:
        if inside:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append(ch)
        elif ch in "}]":
            if stack:
                stack.pop()
            if not stack:
                return False
    return inside or bool(stack)


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("?)', re.S)


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)


def unwrap(raw: str) -> tuple[str, bool]:
    """The answer inside its wrapping, and whether the wrapping is cut off."""
    s = _seen(raw).strip()
    fences = s.count("```")
    cut = fences % 2 == 1
    bare = _FENCE.sub("", s).replace("```", "").strip() if fences else s
    m = _JSON_START.search(bare)
    if m and (m.start() == 0 or not re.search(r"[;(){}]", bare[: m.start()])):
        body = bare[m.start() :]
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(body)
        except ValueError:
            if _open_at_end(body):
                cut = True
            parts = [p[0] for p in _STRING.findall(body)]
            main = next((parts[i + 1] for k in _MAIN_KEYS for i, p in enumerate(parts[:-1]) if p == k), "")
            return main.replace("\\n", "\n"), cut
        if isinstance(value, dict):
            for k in _MAIN_KEYS:
                if isinstance(value.get(k), str):
                    return value[k], cut
            if any(k in value for k in _MAIN_KEYS):
                return "", cut
        return max(_strings(value), key=len, default=""), cut
    if bare[:1] == '"' and bare[-1:] == '"':
        bare = bare[1:-1]
    return bare, cut


def _seen(text: str) -> str:
    return text if text.isascii() else _INVISIBLE.sub("", text)


def plain(text: str) -> str:
    """Without comment marks."""
    return _MARKS.sub("", _seen(text)).strip()


def is_empty(bare: str) -> bool:
    """Whether a text without marks and tags says nothing."""
    return not any(map(str.isalnum, bare)) or len(bare) < 40 and bare.strip("\"'()[]{}<>.…-*_ \t\r\n").lower() in _NOTHING


def last_word(text: str) -> tuple[str | None, bool]:
    """The plain word a text ends in, whatever marks follow, and whether a hyphen does; None if it ends in anything else."""
    end = len(text)
    while end and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    start = end
    while start and "a" <= text[start - 1] <= "z":
        start -= 1
    before = text[start - 1 : start]
    if start == end or before and (before.isalnum() or before in "_`@"):
        return None, False
    return text[start:end], text[end : end + 1] == "-"


def fragment(text: str, flat: str) -> tuple[bool, str | None]:
    """Whether a text (``flat``: without marks) surely stops before its end; else its last word, if only other texts can tell."""
    if "/*" in flat and flat.count("/*") > flat.count("*/") or "*/" not in text and text.lstrip().startswith("/*"):
        return True, None
    tick = flat.rfind("`")
    if tick >= 0 and (flat.count("`") % 2 or tick == 0 or flat[tick - 1].isspace()):  # the last one opens
        return True, None
    last, hyphen = (None, False) if flat[-1:] in ".!?。！？" else last_word(flat)
    if last and (hyphen or last in _DANGLING):
        return True, None
    return False, last


def defect(raw: str | None, expected: str | None, prompt: str) -> tuple[str | None, str | None, str]:
    """(defect, last word to be judged by the corpus, answer) of one reply."""
    if raw is None:
        return "empty", None, ""
    text, cut = unwrap(raw)
    flat = plain(text)
    bare = _TAGS.sub(" ", flat) if "@" in flat else flat
    if is_empty(bare.strip()):
        return ("truncated" if cut else "empty"), None, ""
    if refuses(flat):
        return "refusal", None, flat
    if copies(words_of(bare), prompt):
        return "copied", None, flat
    if cut:
        return "truncated", None, flat
    said = _spoken(bare)
    if said and expected and said != expected:
        return "language", None, flat
    sure, last = fragment(text, flat)
    return ("truncated" if sure else None), last, flat


@lru_cache(4096)
def _asked(head: str) -> str:
    m = re.search(r"\b(?:en|auf|em|на)\s+(français|deutsch|español|português|русском)", head, re.I)
    if m:
        return {"français": "fr", "deutsch": "de", "español": "es", "português": "pt", "русском": "ru"}[m.group(1).lower()]
    return language(head) or "en"


_HEAD = re.compile(r"\n\s*\n|\nComment:|\nCode:")


def instruction_language(prompt: str | None) -> str:
    """Language of what the prompt asks, before the text it is about."""
    m = _HEAD.search(prompt or "")
    return _asked((prompt or "")[: m.start() if m else None])


_ENDS = re.compile(r"(?<![\w`@])([a-z]+)(?![\w`])(?:([.;:,!?]|\s*\n)|(\s*\x01))?")
_SCHEMA = "rec_id long, defect string, last string, word string, inside long, stops long"
_ARROW = pa.schema([("rec_id", pa.int64()), ("defect", pa.string()), ("last", pa.string()), ("word", pa.string()), ("inside", pa.int64()), ("stops", pa.int64())])


def _vocabulary(answers: list[str]) -> tuple[Counter, Counter]:
    """How often each plain word stands inside an answer, and before a stop; an answer's own last word is not counted."""
    inside, stops = Counter(), Counter()
    for w, stop, end in _ENDS.findall(" \x01 ".join(answers) + " \x01"):
        if stop:
            stops[w] += 1
        elif not end:
            inside[w] += 1
    return inside, stops


def _classify(batches: Iterator[pa.RecordBatch], fixed: str | None) -> Iterator[pa.RecordBatch]:
    """(id, reply, prompt) -> a row per defect or suspect, and rows of words."""
    for b in batches:
        rows, answers = [], []
        for i, raw, prompt in zip(*(b.column(k).to_pylist() for k in range(3))):
            what, last, flat = defect(raw, fixed or instruction_language(prompt), prompt or "")
            if what or last:
                rows.append((i, what, last, None, None, None))
            if flat and not what:
                answers.append(flat)
        inside, stops = _vocabulary(answers)
        rows.extend((None, None, None, w, inside[w], stops[w]) for w in inside.keys() | stops.keys())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _replies(df: DataFrame, table: str, fixed: str | None) -> DataFrame:
    return df.mapInArrow(lambda it: _classify(it, fixed), _SCHEMA).withColumn("rec_table", F.lit(table))


def found(calls: DataFrame, runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rec_table, rec_id, defect) of every defective answer, once.

    ``calls`` needs ``call_id``, ``prompt``, ``raw``; ``runs`` needs ``run_id``, ``pair_id``, ``final``,
    ``error``; ``pairs`` needs ``id``, ``written_at``, ``signature``, ``code`` and gives a run's code by
    its valid row. A null answer has no content: it is empty. Runs with ``error`` set are no cases, a
    run without its pair is judged without code. The first that applies of empty, refusal, copied,
    truncated by its wrapping, language and truncated is the defect. Repeated records count once.

    An answer that ends without a stop in a word that answers do not otherwise use is cut off: over all
    answers, the word stands inside them or before a stop no more often than at such an end. The two numbers
    grow alike, so a table twice as large with the same texts gives the same, and a stray use clears nothing
    that ends so as often.
    """
    code = latest(pairs, "code", "signature").select(F.col("id").alias("pair_id"), F.concat_ws("\n", "signature", "code").alias("prompt"))
    done = runs.where(F.col("error").isNull() & F.col("run_id").isNotNull()).select("run_id", "pair_id", "final")
    comments = done.join(code, "pair_id", "left").select("run_id", "final", "prompt")
    asked = calls.where(F.col("call_id").isNotNull()).select("call_id", "raw", "prompt")
    got = cut(_replies(asked, "model_calls", None).unionByName(_replies(comments, "run_records", "en")))
    sure = got.where("defect is not null").select("rec_table", "rec_id", "defect")
    suspects = got.where("defect is null and last is not null").select("rec_table", "rec_id", F.col("last").alias("word"))
    used = got.where("word is not null").groupBy("word").agg(F.sum(F.col("inside") + F.col("stops")).alias("used"))
    ends = suspects.groupBy("word").agg(F.count(F.lit(1)).alias("ends"))
    whole = ends.join(used, "word").where("used > ends").select("word")
    broken = suspects.join(whole, "word", "left_anti").select("rec_table", "rec_id", F.lit("truncated").alias("defect"))
    return sure.unionByName(broken).distinct()


def counts(calls: DataFrame, runs: DataFrame, pairs: DataFrame) -> DataFrame:
    return found(calls, runs, pairs).groupBy("rec_table", "defect").agg(F.count(F.lit(1)).alias("n"))
