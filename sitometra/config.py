"""Vocabularies, conversions and options."""

from __future__ import annotations

from dataclasses import dataclass, field

# Stems of each kind of word, as normalized text has them.
GRAIN = ("σιτ", "πυρ", "κριθ", "ζεα", "ολυρ", "σταχυ", "αλευρ")
UNIT = ("αρταβ", "μεδιμν", "χοινι", "χοινιξ", "μετρ", "κοτυλ", "καλαθ")
MONEY = ("δραχμ", "οβολ", "δηναρ", "μνα", "ταλαντ", "σεστ", "χαλκ")
NEAR_UNIT = ("αρταβ", "μεδιμν", "χοιν", "μετρ", "κοτυλ", "χοινιξ")
PRICEWORD = r"(τιμη|τιμ(?=[\.\)\(]))"
GREEK_NUMERAL = r"(?U)(?<!\w)([α-ωϛϝϟϡ]{1,6}[ʹʹ])(?!\w)"
# The sign for a half, which Java does not count as a word character.
HALF = "\U00010175"
# The first prefix that fits names the canonical form.
GRAIN_NAMES = (("πυρ", "wheat (pyros)"), ("σιτ", "grain (sitos)"), ("κριθ", "barley (krithē)"), ("ζε", "spelt/zea"), ("ολυρ", "emmer (olyra)"), ("αλευρ", "flour (aleuron)"), ("σταχυ", "ear/spike (stachys)"))
UNIT_NAMES = (("αρταβ", "artaba"), ("μεδιμν", "medimnos"), ("χοιν", "choenix"), ("κοτυλ", "kotyle"), ("μετρ", "metretes"))
MONEY_NAMES = (("δραχ", "drachma"), ("οβολ", "obol"), ("δηναρ", "denarius"), ("μνα", "mina"), ("ταλαν", "talent"), ("σεστ", "sestertius"), ("χαλκ", "chalkous"), ("ασσ", "as"))
# Places, first pattern that is found wins.
PLACES = (
    ("oxyrh|οξυρ", "Oxyrhynchite"),
    ("arsin|αρσιν|φαγιουμ|fayum", "Arsinoite"),
    ("hermop|ερμοπ", "Hermopolite"),
    ("herakleop|ηρακλεοπ", "Herakleopolite"),
    ("memph|μεμφ", "Memphite"),
    ("panop|πανοπ|akhmim", "Panopolite"),
    ("theb|θηβ|λυκοπ|lycop", "Thebaid"),
    ("alex|αλεξανδρ", "Alexandria"),
)
# Litres in a unit; drachmas in a coin, in the wide and the narrow table.
LITRES = {"artaba": 38.8, "choenix": 1.08, "medimnos": 52.5, "kotyle": 0.27, "metretes": 39.0}
DRACHMAS_WIDE = {"drachma": 1.0, "obol": 1 / 6, "chalkous": 1 / 48, "denarius": 4.0, "sestertius": 1.0, "mina": 100.0, "talent": 6000.0}
DRACHMAS_NARROW = {"drachma": 1.0, "obol": 1 / 6, "chalkous": 1 / 48}


@dataclass(frozen=True)
class Lexicon:
    """Stems of a stage's vocabulary; half_is_money: whether the sign for a half counts as money."""

    grain: tuple[str, ...] = GRAIN
    unit: tuple[str, ...] = UNIT
    money: tuple[str, ...] = MONEY
    priceword: str = PRICEWORD
    numeral: str = GREEK_NUMERAL
    half_is_money: bool = True

    @staticmethod
    def word(stems: tuple[str, ...]) -> str:
        return rf"(?U)\b({'|'.join(stems)})\w*"


HARVEST_LEXICON = Lexicon()
LINK_LEXICON = Lexicon(unit=(*UNIT, "γομφ"), half_is_money=False)


@dataclass(frozen=True)
class HarvestOptions:
    scan_commentary: bool = False
    require_number: bool = True
    require_unit: bool = False
    max_snippets: int = 3
    snippet_chars: int = 300
    lexicon: Lexicon = HARVEST_LEXICON


@dataclass(frozen=True)
class LinkOptions:
    scan_commentary: bool = False
    require_unit: bool = False
    window_tokens: int = 80
    min_score: float = 55.0
    topk: int = 1
    global_assign: bool = False
    emit_only_primary: bool = False
    emit_topk_and_primary_only: bool = False
    max_docs: int = 0
    block_chars: int = 2000
    ambiguity_delta: float = 8.0
    context_pad: int = 8
    context_chars: int = 500
    priceword_near: int = 8
    reuse_score: float = 80.0
    reuse_max_dgp: int = 12
    reuse_max_span: int = 18
    line_penalty: str = "parity"
    lexicon: Lexicon = LINK_LEXICON


@dataclass(frozen=True)
class AnalyzeOptions:
    min_score: float = 60.0
    drop_ambiguous: bool = False
    year_bin: int = 25
    review_rows: int = 600
    outlier_z: float = 4.0
    smooth_rows: int = 3
    min_n: int = 1
    top_places: int = 6
    base_first: int = 50
    base_last: int = 99
    grain: str = "wheat (pyros)"


@dataclass(frozen=True)
class GraphOptions:
    min_score: float = 0.0
    drop_ambiguous: bool = False
    year_min: float | None = None
    year_max: float | None = None
    grain: str = "wheat (pyros)"
    min_n_bin: int = 3
    topn_places: int = 6
    mad_z: float | None = 4.0
    winsor: tuple[float, float] | None = None
    extremes: int = 50


@dataclass(frozen=True)
class SampleOptions:
    per_bin: int = 10
    seed: int = 42
    max_score: int = 80
    allow_fill: bool = False
    key: tuple[str, ...] = field(default=("DDB_ID", "Mention_ID", "Grain_Index"))
