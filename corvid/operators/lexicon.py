"""Lexicon features on cleaned text as native column expressions
(TX8-TX13, WN3, FN12, SO6).

* token signals: tokenise, map synonyms to their key, and per key return 1
  if some occurrence is not preceded (at ``offset``) by a negation word, -1
  if every occurrence is, 0 if the key never occurs;
* phrase flags: 1 if some occurrence of an include phrase starts outside
  every exclude occurrence ``[start, start + len]`` (both ends inclusive),
  else 0.  Matching is by substring, not by word.

All phrases of a lexicon are found in one pass over a text: they are folded
into one trie, written as a look-ahead expression that is tried once at each
place and returns the longest phrase that starts there; the shorter ones that
start there too are its prefixes, known beforehand.  Only a text that holds
both an include and an exclude phrase of a key is looked at again, for their
places.

Both run per row inside codegen (higher-order array functions, ``rlike``); no
Python runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of non-blank, non-dot characters with inner dots form a word; a run
# of dots (a full stop before a blank or the end) is its own token.
TOKEN_PATTERN = r"[^\s.]+(?:\.[^\s.]+)*|\.+"


@dataclass(frozen=True)
class TokenKey:
    key: str
    synonyms: tuple
    negations: tuple = ()
    offset: int = -1


@dataclass(frozen=True)
class PhraseKey:
    key: str
    include: tuple
    exclude: tuple = ()


# ---------------------------------------------------------------------------
# The source pipeline's token lexicon (key, synonyms,
# negation words; the look-back is one token) and phrase lexicon (key,
# include phrases, exclude phrases), in its order.  Two phrase pairs that
# were fused by missing commas in the source are kept as separate phrases
# ("polytrauma" / "head injury", "lacerations" / "contusions").
# ---------------------------------------------------------------------------
TOKEN_LEXICON = (
    TokenKey("cyclist", ("cyclist", "bike", "motorcycle", "motorbike", "pedestrians/cyclists"), ("no",)),
    TokenKey("ambulance", ("ambulance", "ambula", "ambulances", "helicopter")),
    TokenKey("fatality", ("fatal", "fatality", "death", "die", "demise", "dying", "decease", "deceased",
                          "died", "dies", "dead")),
    TokenKey("injury", ("injury", "injuries", "burns", "injured"), ("no",)),
    TokenKey("motorway", ("motorways", "motorway")),
    TokenKey("shop", ("shop", "shops")),
    TokenKey("property", ("property", "properties", "house", "houses", "accommodation")),
    TokenKey("child", ("child", "children", "kid", "kids", "baby", "babies", "toddler", "toddlers",
                       "infant", "infants")),
)

PHRASE_LEXICON = (
    PhraseKey("potential_high_speed", ("fast speed", "sped", "speeding", "high speed", "extreme speed"),
              ("low speed", "mild speeding", "slow speed")),
    PhraseKey("potential_emergency", (
        "explosion", "helicopter emergency service", "hem", "resuscitation", "emergency service",
        "emergency services", "fire engine", "fire", "police", "attended by fire services",
        "fire incident", "emergency resuscitation", "cutting out from vehicle", "cut out from vehicle",
        "cut from vehicle", "air lifted", "loss of life")),
    PhraseKey("heavy_collision", (
        "train collision", "collision with a train", "lorry collision", "collision with a lorry",
        "heavy vehicle collision", "heavy collision", "commercial vehicle collision",
        "articulated vehicle", "head on collision", "multiple vehicle", "multiple vehicles")),
    PhraseKey("many_claimants", ("claimants",),
              ("multiple claimants", "many claimants", "multiple claims", "many claims")),
    PhraseKey("child_injury", (
        "child injury", "children injury", "kid injured", "kids injured", "child injuries",
        "injured child", "injured children", "injured kid", "injured kids", "injured baby",
        "injured babies", "injured toddler", "injured toddlers", "injured infant", "injured infants")),
    PhraseKey("accident_desc", (
        "windscreen claim", "thrown out of vehicle", "vehicle rolled over", "vehicle turned over",
        "hit bonnet", "thrown into air", "phd degree student", "fell from roof", "fall from roof",
        "fell from height", "fall from height", "onto concrete", "in a bad way")),
    PhraseKey("illness_type", (
        "cancer", "asbestosis", "ptsd", "asbestos related cancers", "complex regional pain syndrome",
        "chronic regional pain syndrome", "severe post traumatic amnesia", "loss of sight",
        "brachial plexus")),
    PhraseKey("injury_nature", (
        "loss of use of upper limb", "loss of use of lower limb", "loss of use of upper limbs",
        "loss of use of lower limbs", "amputations of upper limbs", "amputations of lower limbs",
        "amputation of upper limbs", "fractured os calcis")),
    PhraseKey("claimant_profession", (
        "management board representative", "marketing professional", "accountant",
        "company secretary", "off work", "doctor", "lawyer", "stock market dealer",
        "television personality")),
    PhraseKey("claimant_circumstance", (
        "rehabilitation bio psychosocial yellow", "catastrophising", "black flag",
        "Low expectation about return to work", "fear avoidance behaviour",
        "area of high unemployment", "lack of job satisfaction", "no contact with work",
        "surviving spouse", "surviving children", "surviving child", "illness behaviour",
        "pain behaviour", "pain intensity behaviour", "pain functional behaviour")),
    PhraseKey("accident_outcome", (
        "distinct to rehabilitation assessment", "wheelchair bound", "addenbrookes hospital",
        "phd degree student", "studies affected", "brain scan", "personality change",
        "balance issues", "dizziness", "blurred vision", "cognitive issues", "amnesia", "tinnitus",
        "subarachnoid haemorrhage", "bleed on brain", "seizures", "epilepsy", "neurosurgery",
        "unconscious", "loss of consciousness", "post concussion syndrome", "glasgow coma scale",
        "gcs", "cauda equina", "chiari malformation", "induced coma", "intensive care",
        "prognosis is uncertain", "uncertain prognosis")),
    PhraseKey("injury_severity", (
        "intra-articular fracture", "intra-articular fractures", "comminuted fracture",
        "comminuted fractures", "multiple fractures", "polytrauma", "head injury", "head injuries",
        "lower back injury", "multiple injuries", "spinal injury", "spinal injuries", "chronic pain",
        "skull fractures", "skull fracture"),
              ("mild injury", "mild injuries", "lacerations", "cuts", "bruise", "bruises", "lacerations",
               "contusions")),
    PhraseKey("accident_region", ("rep of ireland", "republic of ireland")),
    PhraseKey("claim_region", ("usa", "canada")),
    PhraseKey("damaged_premises", (
        "business interuption", "loss of business", "aviation industry", "marine industry",
        "microelectronic industry", "computer industry", "oil industry", "film industry",
        "supply of goods to the aviation industry", "supply of goods to the marine industry",
        "supply of goods to the amicroelectronic industry", "supply of goods to the computer industry",
        "supply of goods to the oil industry", "supply of goods to the film industry",
        "supply of services to the aviation industry", "supply of services to the marine industry",
        "supply of services to the microelectronic industry",
        "supply of services to the computer industry", "supply of services to the oil industry",
        "supply of services to the film industry")),
)


# -- tokens ------------------------------------------------------------------

def tokenize(col) -> Column:
    """TX8: tokens of cleaned text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), 0)


def synonym_map(lexicon: Sequence[TokenKey]) -> dict[str, str]:
    """Synonym -> key; a synonym listed under two keys belongs to the later."""
    out: dict[str, str] = {}
    for entry in lexicon:
        for w in entry.synonyms:
            out[w] = entry.key
    return out


def normalise(tokens: Column, lexicon: Sequence[TokenKey]) -> Column:
    """TX9: replace each synonym by its key (a config-sized literal map)."""
    mapping = synonym_map(lexicon)
    if not mapping:
        return tokens
    lit_map = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(lit_map, t), t))


def token_signal(norm: Column, entry: TokenKey, reduce: str = "max") -> Column:
    """TX10 + WN3 + FN12 for one key: max over occurrences of +1 (plain) or
    -1 (the token at ``offset`` is a negation word); 0 when absent.
    ``reduce="sum"`` adds the occurrences up instead (Q25)."""
    if reduce not in ("max", "sum"):
        raise ValueError(f"reduce: max or sum, not {reduce!r}")
    key = F.lit(entry.key)
    if reduce == "max" and not entry.negations:
        return F.when(F.array_contains(norm, key), F.lit(1)).otherwise(F.lit(0))
    negs = list(entry.negations)

    def code(x, i):
        # NULL off the key, so the maximum runs over occurrences only.
        neighbour = F.get(norm, i + F.lit(entry.offset))
        negated = F.coalesce(neighbour.isin(negs), F.lit(False))
        return F.when(x == key, F.when(negated, F.lit(-1)).otherwise(F.lit(1)))
    codes = F.transform(norm, code)
    if reduce == "sum":
        return F.coalesce(F.aggregate(codes, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))), F.lit(0))
    return F.coalesce(F.array_max(codes), F.lit(0))


def token_signals(df: DataFrame, text_col: str, lexicon: Sequence[TokenKey] = TOKEN_LEXICON,
                  keep: Sequence[str] = (), reduce: str = "max") -> DataFrame:
    """TX11: one integer column per key (keys in sorted order, SO6)."""
    staged = df.select(*keep, normalise(tokenize(text_col), lexicon).alias("_norm"))
    cols = [token_signal(F.col("_norm"), e, reduce).alias(e.key)
            for e in sorted(lexicon, key=lambda e: e.key)]
    return staged.select(*keep, *cols)


# -- phrases -----------------------------------------------------------------

def has_border(s: str) -> bool:
    """True when a proper prefix of ``s`` is also its suffix, i.e. two
    occurrences can overlap, so scanning left to right skips some."""
    return any(s[:k] == s[-k:] for k in range(1, len(s)))


def _guards(phrase: str, exclude: Sequence[str]) -> str:
    """Zero-width tests placed before ``phrase``: fail where an exclude
    occurrence covers the start, end position included (Q22).

    For an exclude ``e`` split as ``a + b`` with the start between them, the
    guard is ``(?!(?<=a)b)``; splits whose ``b`` disagrees with the phrase
    can never fire and are left out.  ``b`` empty is ``(?<!e)``.
    """
    out = []
    for e in dict.fromkeys(exclude):
        for k in range(len(e) + 1):
            a, b = e[:k], e[k:]
            n = min(len(b), len(phrase))
            if b[:n] != phrase[:n]:
                continue
            if not b:
                out.append(f"(?<!{re.escape(a)})")
            elif not a:
                out.append(f"(?!{re.escape(b)})")
            else:
                out.append(f"(?!(?<={re.escape(a)}){re.escape(b)})")
    return "".join(out)


def phrase_regex(entry: PhraseKey) -> str:
    """TX12: one Java regex per key; ``rlike`` finds an include occurrence
    whose start no exclude occurrence covers.  The phrase is looked for
    before its guards, which cost more."""
    alts = [f"(?={re.escape(p)}){_guards(p, entry.exclude)}" for p in dict.fromkeys(entry.include)]
    return "|".join(alts)


def trie_regex(phrases: Sequence[str]) -> str:
    """A regex that matches the longest of ``phrases`` at a place, character by character through their trie."""
    root: dict = {}
    for p in phrases:
        node = root
        for ch in p:
            node = node.setdefault(ch, {})
        node[""] = {}

    def text(node: dict) -> str:
        ways = [re.escape(ch) + text(node[ch]) for ch in sorted(node) if ch]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{body})?" if "" in node else body
    return text(root)


def phrases_found(text: Column, phrases: Sequence[str]) -> Column:
    """The longest of ``phrases`` at each place where one starts, each text once; overlaps count."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({trie_regex(phrases)}))"), 1))


def needs_scan(entry: PhraseKey) -> bool:
    """Self-overlapping phrases make left-to-right scanning skip starts; only
    then does the exact answer need the scan below instead of a regex."""
    return bool(entry.exclude) and any(has_border(p) for p in (*entry.include, *entry.exclude))


def scan_flag(text: str, entry: PhraseKey) -> int:
    """Reference rule by explicit scanning (non-overlapping occurrences)."""
    if text is None:
        return 0
    spans = []
    for e in entry.exclude:
        spans += [(m.start(), m.start() + len(e)) for m in re.finditer(re.escape(e), text)]
    for p in entry.include:
        for m in re.finditer(re.escape(p), text):
            s = m.start()
            if not any(lo <= s <= hi for lo, hi in spans):
                return 1
    return 0


def _starts(text: Column, phrase: str) -> Column:
    """Start offsets of the non-overlapping occurrences of a literal, left to right, from the lengths of the pieces between."""
    lengths = F.transform(F.split(text, re.escape(phrase), -1), lambda x: F.length(x))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n + len(phrase)).alias("at"), F.array_append(acc["out"], acc["at"] + n).alias("out"))
    # The piece after the last occurrence starts nothing.
    return F.aggregate(F.slice(lengths, F.lit(1), F.size(lengths) - 1), first, step, lambda acc: acc["out"])


def _scan(text: Column, entry: PhraseKey) -> Column:
    """``scan_flag`` in built-in functions."""
    starts = F.concat(*[_starts(text, p) for p in dict.fromkeys(entry.include)])
    spans = F.concat(*[_spans(text, e) for e in dict.fromkeys(entry.exclude)])
    free = F.element_at(F.transform(F.array(spans), lambda xs: F.exists(
        starts, lambda s: ~F.exists(xs, lambda x: (x["lo"] <= s) & (s <= x["hi"])))), 1)
    return free.cast("int")


def _spans(text: Column, phrase: str) -> Column:
    return F.transform(_starts(text, phrase), lambda s: F.struct(s.alias("lo"), (s + len(phrase)).alias("hi")))


def phrase_flag(text: Column, found: Column, entry: PhraseKey, phrases: Sequence[str]) -> Column:
    """TX12 for one key, given the phrases ``found`` in the text out of ``phrases``."""
    def some(wanted: Sequence[str]) -> Column:
        # A phrase found stands for all that start like it.
        marks = [p for p in phrases if p.startswith(tuple(wanted))]
        return F.arrays_overlap(found, F.array(*[F.lit(p) for p in marks]))
    if not entry.include:
        return F.lit(0)
    hit = some(entry.include)
    if not entry.exclude:
        return F.coalesce(hit.cast("int"), F.lit(0))
    exact = _scan(text, entry) if needs_scan(entry) else text.rlike(phrase_regex(entry)).cast("int")
    return F.when(~F.coalesce(hit, F.lit(False)), F.lit(0)).when(~some(entry.exclude), F.lit(1)).otherwise(exact)


def phrase_flags(df: DataFrame, text_col: str, lexicon: Sequence[PhraseKey] = PHRASE_LEXICON,
                 keep: Sequence[str] = (), word_boundary: bool = False) -> DataFrame:
    """TX13: one 0/1 column per key (keys in sorted order); a NULL text has no phrase.

    ``word_boundary`` (Q21) lets phrases match whole words only: with a
    boundary at both ends, occurrences are found as runs of words, so the
    text and every phrase are padded by one space.
    """
    if any(not p for e in lexicon for p in (*e.include, *e.exclude)):
        raise ValueError("an empty phrase")
    text = F.col(text_col)
    if word_boundary:
        text = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), "[^a-zA-Z0-9]+", "  ")
        pad = lambda ps: tuple(f" {'  '.join(re.findall('[a-zA-Z0-9]+', p))} " for p in ps)
        lexicon = [PhraseKey(e.key, pad(e.include), pad(e.exclude)) for e in lexicon]
    phrases = sorted({p for e in lexicon for p in (*e.include, *e.exclude)})
    staged = df.select(*keep, text.alias("_text"))
    if phrases:
        staged = staged.withColumn("_found", phrases_found(F.col("_text"), phrases))
    return staged.select(*keep, *[phrase_flag(F.col("_text"), F.col("_found"), e, phrases).alias(e.key)
                                  for e in sorted(lexicon, key=lambda e: e.key)])


# -- lint --------------------------------------------------------------------

def lint(tokens: Sequence[TokenKey] = TOKEN_LEXICON,
         phrases: Sequence[PhraseKey] = PHRASE_LEXICON) -> list[tuple[str, str, str]]:
    """Entries that can never match cleaned text (Q19), repeats, and
    self-overlapping phrases.  Returns (key, entry, reason)."""
    bad = re.compile(r"[^a-z0-9. ]")
    out = []
    for t in tokens:
        for w in (*t.synonyms, *t.negations):
            if bad.search(w) or " " in w:
                out.append((t.key, w, "cannot be a token of cleaned text"))
    for p in phrases:
        for group, words in (("include", p.include), ("exclude", p.exclude)):
            for w in words:
                if bad.search(w) or "  " in w:
                    out.append((p.key, w, f"{group} phrase cannot occur in cleaned text"))
                if has_border(w):
                    out.append((p.key, w, f"{group} phrase overlaps itself"))
            for w in {w for w in words if words.count(w) > 1}:
                out.append((p.key, w, f"{group} phrase repeated"))
    return out
