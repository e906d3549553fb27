"""Which attribute a statement is about, whose it is, and what a question asks for.

Pure Python over single strings: statements are tagged in Arrow batches through :func:`tag_column`,
questions and distinct attribute names are few and handled on the driver.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed as K

_set = lambda words: frozenset(words.split())
_CLASS_OF = {name: kind for kind, names in K.CLASSES.items() for name in [kind, *names.split()]}
_REVISION, _KEPT, _TRIM = _set(K.REVISION_WORDS), _set(K.KEPT_WORDS), _set(K.FUNCTION_WORDS) | _set(K.TAIL_ADVERBS)
_EMPTY, _FRAMES, _CASED, _CREDENTIAL = _set(K.EMPTY_HEADS), _set(K.FRAMES), _set(K.CASED_SHAPES), _set(K.CREDENTIAL_WORDS)
_OWNED_SLOTS = tuple(map(re.compile, (K.SLOT_NAMED, K.SLOT_IS, K.SLOT_CHANGED)))
_LOOSE_SLOTS = tuple(map(re.compile, (K.SLOT_RECENT, K.SLOT_USED)))
_ASKED = tuple(map(re.compile, (K.ASKED_WHAT_USED, K.ASKED_ABOUT, K.ASKED_OWN, K.ASKED_WHICH)))
_BINDING = (*_OWNED_SLOTS, *(re.compile(p) for p in (K.ASKED_OWN, K.ASKED_ABOUT)))
_STRUCTURE = tuple((name, re.compile(p)) for name, p in K.STRUCTURE)
_RE = {name: re.compile(getattr(K, name)) for name in ("PHONE_CUE", "ROUTINE", "INNER_POSSESSIVE", "NAME_TOKEN", "FIRST_PERSON", "OTHERS_POSSESSIVE", "PRONOUN_LED", "OWN", "NAME_VALUE", "PAST_FRAME", "ANTERIOR_STRONG", "ANTERIOR_WEAK", "IMMEDIATE", "INITIAL_STRONG", "INITIAL_WEAK")}
_LATIN = "[a-zÀ-ɏ]"


def fold(text) -> str:
    return unicodedata.normalize("NFKC", "" if text is None else str(text))


def normalize_entity(name) -> str:
    """An attribute name as lower-case words joined by underscores, at most 48 characters."""
    out = fold(name).strip().lower()
    for spelling, common in K.SPELLINGS.items():
        out = out.replace(spelling, common)
    return re.sub("[^a-z0-9]+", "_", out).strip("_")[: K.MAX_NAME]


def _singular(word: str) -> str:
    return word[:-1] if len(word) > 3 and word[-1] == "s" and word[-2] != "s" else word


def _trimmed(words: list[str]) -> list[str]:
    """Without the function words and adverbs at the end."""
    return words[: max((k + 1 for k, w in enumerate(words) if w not in _TRIM), default=0)]


def _role_first(low: str) -> str:
    """ "colleague ann lee's desk phone" as "colleague desk phone": the role before the name, then the attribute."""
    inner = _RE["INNER_POSSESSIVE"].search(low)
    return low if inner is None else f"{next(iter(re.findall(_LATIN + '+', inner['lead'])), inner['owner'])} {inner['attr']}"


#: What becomes of the words of a slot, in order.
_SLOT_STEPS = (
    lambda words: list(itertools.dropwhile(lambda w: w in _REVISION - _KEPT, words)),
    lambda words: _trimmed(_trimmed(words)[:3]),
    lambda words: ["alternate", *words[1:]] if words[:1] == ["other"] else words,  # "other_" is kept for the facts of other people
    lambda words: [*words[:-1], *map(_singular, words[-1:])],
    lambda words: [] if {*words[:1], *words[-1:]} & _EMPTY else words,
)


def normalize_slot(phrase) -> str | None:
    """The attribute that a noun phrase after a possessive names, or None if it names none."""
    words = [w for w in normalize_entity(_role_first(fold(phrase).strip().lower())).split("_") if w]
    for step in _SLOT_STEPS:
        words = step(words)
    name = "_".join(words)
    return _CLASS_OF.get(name, name) or None


def proper_names(text) -> frozenset[str]:
    """Lower-cased words that are capitalised within a sentence."""
    whole = fold(text)
    found = set()
    for m in _RE["NAME_TOKEN"].finditer(whole):
        before = whole[max(0, m.start() - 64) : m.start()].rstrip() if m.start() else ""
        if not before and m.start() > 64:
            before = whole[: m.start()].rstrip()[-1:]
        if before and before[-1] not in K.SENTENCE_BREAKS and m[0].lower() != "i":
            found.add(m[0].lower())
    return frozenset(found)


def _shape(text: str, low: str) -> str | None:
    """The first class whose shape or frame the text shows."""
    for name, pattern in _STRUCTURE:
        if name == "phone_number":
            long_enough = any(sum(c.isdigit() for c in m[0]) >= K.PHONE_DIGITS for m in pattern.finditer(text))
            if long_enough and (_RE["PHONE_CUE"].search(low) or re.search(r"\bmy\b", low)):
                return name
        elif pattern.search(text if name in _CASED else low):
            return name
    return None


def _slot(low: str, names: frozenset[str], owned_only: bool) -> str | None:
    """The attribute named by a slot of the sentence, unless the slot holds a proper name (then it is a value)."""
    for pattern in _OWNED_SLOTS if owned_only else (*_OWNED_SLOTS, *_LOOSE_SLOTS):
        m = pattern.search(low)
        found = normalize_slot(m["slot"]) if m else None
        if found and not names & set(found.split("_")):
            return found
    return "routine" if not owned_only and _RE["ROUTINE"].search(low) else None


def split_qualified(name) -> tuple[frozenset[str], str | None]:
    """Qualifiers of an attribute name, and the class that its longest tail names."""
    words = strip_other(name).split("_")
    words = [w for w in words if w]
    cut = next((k for k in range(len(words)) if "_".join(words[k:]) in _CLASS_OF), None)
    kind = None if cut is None else _CLASS_OF["_".join(words[cut:])]
    quals = words if cut is None else words[:cut]
    return frozenset(w for w in quals if w not in _REVISION and (kind is None or _CLASS_OF.get(w) != kind)), kind


def _narrows(slot: str, kind: str) -> bool:
    words = [w for w in slot.split("_") if w]
    if len(words) < 2:
        return False
    quals, head = split_qualified(slot)
    return bool(quals) if head == kind else kind == "credential" and _singular(words[-1]) in _CREDENTIAL


class _Statement:
    """What a statement shows; each part is worked out when a rule asks for it."""

    def __init__(self, text):
        self.whole = fold(text)
        self.low, self.names = self.whole.lower(), proper_names(self.whole)

    @functools.cached_property
    def shape(self) -> str | None:
        return _shape(self.whole, self.low)

    @functools.cached_property
    def slot(self) -> str | None:
        return _slot(self.low, self.names, owned_only=False)

    @functools.cached_property
    def owned(self) -> str | None:
        return _slot(self.low, self.names, owned_only=True)


#: Which attribute a statement is about: the first of these that gives a name.
_NAMING_RULES = (
    # a frame's verb fits several attributes, and the owned slot says which
    lambda s: s.owned if s.shape in _FRAMES and s.owned and not entities_match(s.owned, s.shape) else None,
    # a slot that is a narrower case of what the shape shows
    lambda s: s.slot if s.shape and s.shape not in _FRAMES and s.slot not in (None, s.shape) and _narrows(s.slot, s.shape) else None,
    lambda s: s.shape,
    lambda s: s.slot,
)


def detect_entity(text) -> str | None:
    """The attribute that a statement is about, ``other_``-prefixed if it is somebody else's, or None."""
    if not text:
        return None
    seen = _Statement(text)
    found = next(filter(None, (rule(seen) for rule in _NAMING_RULES)), None)
    return K.THIRD_PARTY + found if found and is_third_party(seen.whole) else found


def strip_other(name) -> str:
    return normalize_entity(name).removeprefix(K.THIRD_PARTY)


def as_other(name) -> str:
    own = strip_other(name)
    return K.THIRD_PARTY + own if own else ""


def is_first_person(text) -> bool:
    return bool(_RE["FIRST_PERSON"].search(fold(text).lower()))


def _binding_possessive(low: str) -> str | None:
    """The possessive that binds the attribute, by the first pattern that shows one."""
    shown = (m["poss"].strip() for m in (p.search(low) for p in _BINDING) if m and m["poss"])
    return next(filter(None, shown), None)


#: Whose an attribute is: of the first test that applies, the verdict "somebody else's".
_OWNER_RULES = (
    (lambda low: not _RE["OTHERS_POSSESSIVE"].search(low), lambda low: False),
    (lambda low: _binding_possessive(low), lambda low: _binding_possessive(low) not in _set(K.OWN_POSSESSIVES)),
    (lambda low: True, lambda low: not _RE["FIRST_PERSON"].search(low)),
)


def is_third_party(text) -> bool:
    """Whether the attribute belongs to somebody else: by the possessive that binds it, else by the whole sentence."""
    low = fold(text).lower()
    return next(verdict(low) for applies, verdict in _OWNER_RULES if applies(low))


def inherit_entity(previous, text) -> str | None:
    """What a follow-up without a subject is about, given the attribute before it."""
    name = normalize_entity(previous)
    if not name:
        return None
    return as_other(name) if is_third_party(text) else strip_other(name) if is_first_person(text) else name


def is_pronoun_led(text) -> bool:
    low = fold(text).strip().lower()
    return bool(_RE["PRONOUN_LED"].match(low)) and not _RE["OWN"].search(low)


def is_personal_query(text) -> bool:
    low = fold(text).lower()
    return any(p in low for p in K.PERSONAL_PHRASES) or bool(set(re.findall("[a-z']+", low)) & _set(K.PERSONAL_WORDS))


def self_name_tokens(text) -> frozenset[str]:
    m = _RE["NAME_VALUE"].search(fold(text).lower())
    return frozenset(re.findall(_LATIN + "{3,}", m["value"])) - _set(K.NAME_STOP) if m else frozenset()


def query_intents(text, self_named: bool = False) -> tuple[str, ...]:
    """Every attribute that a question may be about, the best guess first."""
    others = not self_named and is_third_party(text)
    if not text or not (others or self_named or is_personal_query(text)):
        return ()
    low = fold(text).lower()
    words = set(re.findall("[a-z]+", low))
    slots = [normalize_slot(m["slot"]) for m in (p.search(low) for p in _ASKED) if m]
    phrases = [name for name, cues in K.ASKED_PHRASES if any(c in low for c in cues)]
    spoken = [name for name, cues in K.ASKED_WORDS if words & _set(cues)]
    place = ["location"] if low.strip().startswith("where") else []
    return tuple(dict.fromkeys(as_other(n) if others else n for n in [*slots, *phrases, *spoken, *place] if n))


def entity_class(name) -> str | None:
    full = normalize_entity(name)
    if full.startswith(K.THIRD_PARTY):
        own = full.removeprefix(K.THIRD_PARTY)
        return K.THIRD_PARTY + _CLASS_OF.get(own, own) if own else full
    return _CLASS_OF.get(full, full) or None


def entities_match(a, b) -> bool:
    """Whether two names mean one attribute. Somebody else's never matches one's own."""
    a, b = normalize_entity(a), normalize_entity(b)
    if not a or not b or a.startswith(K.THIRD_PARTY) != b.startswith(K.THIRD_PARTY):
        return False
    if a == b or entity_class(a) == entity_class(b):
        return True
    wa, wb = ({w for w in x.split("_") if w and w not in _REVISION} for x in (a, b))
    (qa, ka), (qb, kb) = split_qualified(a), split_qualified(b)
    if wa == wb or (ka is not None and ka == kb and qa == qb):
        return True
    if wa & _CREDENTIAL and wb & _CREDENTIAL:
        ra, rb = wa - _CREDENTIAL, wb - _CREDENTIAL
        return not ra or not rb or bool(ra & rb)
    return False


def matching_names(name, names) -> list[str]:
    return [n for n in names if n and entities_match(name, n)] if name else []


def is_single_valued(name) -> bool:
    kind = entity_class(name) or ""
    return kind in _set(K.SINGLE_VALUED) or kind.startswith("favorite_")


def _says(text, cues: tuple[str, ...]) -> bool:
    low = fold(text).lower()
    words = set(re.findall("[a-z]+", low))
    return any((c in low) if " " in c else (c in words) for c in cues)


def has_temporal_cue(text) -> bool:
    return _says(text, K.TIME_CUES)


def has_revision_marker(text) -> bool:
    return _says(text, K.CHANGE_MARKERS)


def query_direction(text, default: str = "current") -> str:
    """``current``, ``previous``, ``oldest``, or ``historical`` where the wording asks for the past without saying which."""
    low = fold(text).lower()
    past = bool(_RE["PAST_FRAME"].search(low))
    if not (_RE["ANTERIOR_STRONG"].search(low) or (past and _RE["ANTERIOR_WEAK"].search(low))):
        return default
    if _RE["IMMEDIATE"].search(low):
        return "previous"
    if _RE["INITIAL_STRONG"].search(low) or (past and _RE["INITIAL_WEAK"].search(low)):
        return "oldest"
    return "historical"


def is_explicit_history(direction) -> bool:
    return str(direction or "").strip().lower() in _set(K.EXPLICIT_HISTORY)


def resolve_direction(direction, text, default_mode: str = "oldest") -> tuple[bool, str]:
    """Whether the past is asked for, and which member of it."""
    said = str(direction or "current").strip().lower()
    if said in _set(K.EXPLICIT_PRESENT):
        return False, default_mode
    want = said if said in _set(K.EXPLICIT_HISTORY) else query_direction(text)
    return want != "current", want if want in ("oldest", "previous") else default_mode


def temporal_question(text, direction, intent=None, personal: bool = True) -> bool:
    return is_explicit_history(direction) or (personal and (intent is not None or is_personal_query(text) or has_temporal_cue(text)))


def temporal_applies(top_entity, text, direction, intent=None) -> bool:
    return is_explicit_history(direction) or has_temporal_cue(text) or is_single_valued(top_entity) or (bool(intent) and is_personal_query(text))


def derive_migrated(text, tag) -> str | None:
    """A migrated record keeps a tag that names a class; any other is detected anew."""
    name = normalize_entity(tag)
    return _CLASS_OF[name] if name in _CLASS_OF else detect_entity(text)


def tag_column(text: Column) -> Column:
    """:func:`detect_entity` over a column, in Arrow batches."""

    @F.pandas_udf("string")
    def tag(texts: pd.Series) -> pd.Series:
        return texts.map(detect_entity, na_action="ignore")

    return tag(text)
