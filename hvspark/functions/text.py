"""Text metrics, readability, and sentences taken apart into subject, relation and object."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = "words int, sentences int, syllables int, vowels int, consonants int, punctuation int"
_STOP, _MARKS = ".!?", ",;:()[]{}\"'-"
_WIDE = re.compile("[\u0800-\ud7ff\uf000-\uffff]")


def metrics_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Counts in one pass. Blanks and marks end words; a wide character is a word and a syllable.

    A syllable is a run of vowels; y is a consonant where it starts a word, else a vowel.
    """
    words = sentences = syllables = vowels = consonants = punctuation = 0
    inside = after_vowel = False
    for c in text or "":
        low = c.lower() if c < "\x80" else c
        if low in "aeiou" or (low == "y" and inside):
            vowels += 1
            syllables += not after_vowel
            inside = after_vowel = True
            continue
        after_vowel = False
        if "a" <= low <= "z" and c < "\x80":
            consonants += 1
            inside = True
        elif c in " \t\n\r" or c in _STOP or c in _MARKS:
            words += inside
            inside = False
            if c not in " \t\n\r":
                punctuation += 1
                sentences += c in _STOP
        elif c >= "\x80":
            if _WIDE.match(c):
                words += inside + 1
                syllables += 1
                inside = False
            else:
                inside = True
    return words + inside, sentences, syllables, vowels, consonants, punctuation


def text_metrics(text: Column) -> Column:
    """A struct of the counts."""

    @F.pandas_udf(METRICS)
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metrics_of(None if x is None or x != x else x) for x in column], columns=[c.split()[0] for c in METRICS.split(", ")])

    return run(text)


_ENDS = r" \t\n\r.!?,;:()\[\]{}\"'\-"


def metrics_columns(text: Column) -> dict[str, Column]:
    """The same counts by regular expressions in the JVM, for texts whose characters aren't wide."""
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    letters = r"A-Za-z\x{80}-\x{10ffff}"
    skip = rf"[^{_ENDS}{letters}]*"  # ASCII that neither ends nor starts a word
    plain = F.regexp_replace(text, rf"(^|[{_ENDS}])({skip})[yY]", "$1$2b")
    vowels = count(plain, "[aeiouyAEIOUY]")
    return {
        "words": count(text, rf"{skip}[{letters}][^{_ENDS}]*"),
        "sentences": count(text, "[.!?]"),
        "syllables": count(plain, "[aeiouyAEIOUY]+"),
        "vowels": vowels,
        "consonants": count(plain, "[A-Za-z]") - vowels,
        "punctuation": count(text, r"[.!?,;:()\[\]{}\"'\-]"),
    }


def readability(words: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch's ease of reading; 0 without words or sentences."""
    return F.when((words == 0) | (sentences == 0), 0.0).otherwise(206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words))


PREPOSITIONS = frozenset(
    "about above across after against along amid among around as at before behind below beneath beside between beyond by concerning despite down during except for from in inside into like near of off on onto opposite out outside over past per regarding since than through throughout till to toward towards under unlike until up upon via with within without".split()
)
AUXILIARIES = frozenset("am are been being gets got gotten had has have is was were".split())
DETERMINERS = frozenset("a an any each every her his its my no our some that the their these this those your".split())
CONJUNCTIONS = frozenset("and but nor or".split())
ADVERBS = frozenset("actually already also always carefully certainly clearly currently deeply directly easily even exactly finally generally highly however just mostly nearly never often only perhaps possibly probably quickly quite rapidly really recently simply slowly sometimes still strongly suddenly truly usually very widely".split())
COPULAS = frozenset("am are is was were".split())
PARTICIPLES = frozenset("been done gone seen known given taken made found told left kept begun shown heard held brought written sat stood lost met led grown built sent fallen bought felt spoken spent won taught eaten drunk driven broken caught drawn flown meant thought paid run put set read".split())
#: base forms, forms that no rule leads back to them, and forms that the rules do but which are known as verbs
_BASES = "allow appear ask be become begin believe belong break bring build buy call carry catch cause close come connect consider contain create define describe develop do draw drink drive eat expect fall feel find fly follow get give go grow have hear help hold include involve keep kill know lead learn leave let live lose love make mean meet move need offer open own pay play produce provide put raise read remain remember represent require run say see send serve set show sit speak spend stand start stop suggest support take teach tell think try turn use want win work write".split()
_FORMS = {
    "allow": "allowed", "appear": "appeared", "be": "am are been is was were", "become": "became", "begin": "began begun", "belong": "belonged", "break": "broke broken", "bring": "brought", "build": "built", "buy": "bought", "call": "called", "catch": "caught", "come": "came coming", "consider": "considered", "contain": "contained", "create": "created", "develop": "developed", "do": "did does done", "draw": "drawn drew", "drink": "drank drunk", "drive": "driven drove", "eat": "ate eaten", "fall": "fallen fell", "feel": "felt", "find": "found", "fly": "flew flown", "follow": "followed", "get": "got gotten", "give": "gave given giving", "go": "goes gone went", "grow": "grew grown", "have": "had has having", "hear": "heard", "help": "helped", "hold": "held", "include": "included", "keep": "kept", "kill": "killed", "know": "knew known", "lead": "led", "learn": "learned learnt", "leave": "leaving left", "live": "living", "lose": "losing lost", "make": "made making", "mean": "meant", "meet": "met", "move": "moving", "offer": "offered", "open": "opened", "own": "owned", "pay": "paid", "play": "played", "provide": "provided", "remain": "remained", "remember": "remembered", "run": "ran", "say": "said", "see": "saw seeing seen", "send": "sent", "show": "showed shown", "sit": "sat", "speak": "spoke spoken", "spend": "spent", "stand": "stood", "take": "taken taking took", "teach": "taught", "tell": "telling told", "think": "thought", "turn": "turned", "use": "using", "win": "won", "write": "written wrote",
}
_KNOWN = "allows appears asked asks becomes begins being believed believes belongs breaks brings building builds buys calls carried carries catches caused causes closed closes comes connected connects considers contains creates creating defined defines described describes develops draws drinks drives eats expected expects falls feels finding finds flies follows gets getting gives going grows hears helps holding holds includes involved involves keeping keeps kills knows leading leads learns leaves lets letting lived lives loses loved loves makes means meets moved moves needed needs offers opens owns pays plays produced produces provides puts putting raised raises reads remains remembers represented represents required requires running runs says sees sends served serves sets setting showing shows sits sitting speaks spends standing stands started starts stopped stops suggested suggests supported supports takes teaches tells thinking thinks tried tries turns used uses wanted wants wins worked works writes writing".split()
IRREGULAR: dict[str, str] = {form: verb for verb, forms in _FORMS.items() for form in forms.split()}
IRREGULAR |= {verb: verb for verb in _BASES if verb not in IRREGULAR}
KNOWN = (frozenset(IRREGULAR) - frozenset(_BASES)) | frozenset(_KNOWN)
_ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TRIM = _ASCII_MARKS.replace("-", "").replace("'", "")


def lemma(word: str) -> str | None:
    """A verb's base form, by a table or its ending; None for what looks like no verb."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return None
    doubled = lambda stem: len(stem) > 1 and stem[-1] == stem[-2]
    if word.endswith("ing") and len(word) > 4:
        stem = word[:-3]
        return stem[:-1] if doubled(stem) else stem + "e" if stem[-1] == "t" else stem
    if word.endswith("ed") and len(word) > 3:
        stem = word[:-2]
        if word.endswith("ied") and len(word) > 4:
            return word[:-3] + "y"
        return stem[:-1] if doubled(stem) else stem if stem[-1] in "tdk" else stem + "e"
    if word.endswith("es") and len(word) > 3:
        if word.endswith("ies"):
            return word[:-3] + "y"
        return word[:-2] if word.endswith(("ches", "shes", "sses", "xes", "zes")) else word[:-1]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return None


def _noun(tokens: list[str]) -> str:
    return " ".join(t for t in tokens if t.lower() not in DETERMINERS and t.lower() not in ADVERBS)


def _clauses(sentence: str) -> list[str]:
    """Two clauses where a conjunction joins subjects that share a verb."""
    words = sentence.split()
    bare = [w.strip(_ASCII_MARKS).lower() for w in words]
    if len(words) >= 5:
        for i in range(1, len(words) - 1):
            if bare[i] in CONJUNCTIONS:
                rest = bare[i + 1 :]
                verb = next((j for j, w in enumerate(rest) if w in KNOWN), None)
                if verb is None:
                    verb = next((j for j, w in enumerate(rest) if lemma(w)), None)
                if verb:
                    tail = words[i + 1 + verb :]
                    return [" ".join(words[:i] + tail), " ".join(words[i + 1 : i + 1 + verb] + tail)]
    return [sentence]


def _passive(t: list[str], low: list[str]) -> tuple[str, str, str] | None:
    for i in range(1, len(t)):
        if low[i] in AUXILIARIES:
            at = i + 1
            while at < len(t) and low[at] in ADVERBS:
                at += 1
            if at < len(t):
                verb = lemma(low[at])
                by = low.index("by", at + 1) if "by" in low[at + 1 :] else None
                if verb is None or by is None:
                    return None
                agent, patient = _noun(t[by + 1 :]), _noun(t[:i])
                if agent and patient:
                    return agent, verb, patient
    return None


def decompose(text: str | None) -> list[tuple[str, str, str]]:
    """(subject, relation, object) of each clause: passives turned round, ``is_a`` for copulas, verbs with their preposition."""
    out = []
    for sentence in re.split("[.!?;]", text or ""):
        for clause in _clauses(sentence.strip()):
            t = [w for w in (x.strip(_TRIM) for x in clause.split()) if w]
            low = [w.lower() for w in t]
            if len(t) < 2:
                continue
            if unit := _passive(t, low):
                out.append(unit)
                continue
            for i in range(1, len(t) - 1):
                if low[i] in COPULAS:
                    if lemma(low[i + 1]) and (low[i + 1].endswith(("ed", "en")) or low[i + 1] in PARTICIPLES):
                        continue
                    a, b = _noun(t[:i]), _noun(t[i + 1 :])
                    if a and b:
                        out.append((a, "is_a", b))
                        break
            for i in range(1, len(t)):
                verb = lemma(low[i])
                if not verb or verb == "be":
                    continue
                a = _noun(t[:i])
                if i + 2 < len(t) and low[i + 1] in PREPOSITIONS and a and (b := _noun(t[i + 2 :])):
                    out.append((a, f"{verb}_{low[i + 1]}", b))
                    break
                if a and (b := _noun(t[i + 1 :])):
                    out.append((a, verb, b))
                    break
    return out


def units(text: Column) -> Column:
    """An array of (s, r, o)."""

    @F.pandas_udf("array<struct<s:string,r:string,o:string>>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip("sro", u)) for u in decompose(None if x is None or x != x else x)] for x in column])

    return run(text)
