"""The survey sheet as data: columns, printed answers, character rules and geometry.

Fixed values of the sheet and its rules; everything else in the package looks them up here.
"""

from __future__ import annotations

import unicodedata

# The eleven columns in the sheet's order, and the two kinds of limits on them.
FIELDS = ["bug_name", "symbol", "where", "what_doing", "found_month", "found_day", "location_town", "location_chome", "location_name", "map_symbol", "notice"]
NUMBER_FIELDS = ["found_month", "found_day", "location_chome"]
LETTER_FIELDS = ["map_symbol"]
HEADER_FIELDS = ["school", "grade", "school_class"]
HEADER_NUMBER_FIELDS = ["grade", "school_class"]
ROWS = 8

# The printed answers of the columns that are answered off a list.
CHOICES = {
    "symbol": ["あ", "い", "う", "え", "お", "か", "き", "く", "け"],
    "what_doing": ["①", "②", "③", "④", "⑤", "⑥", "⑦", "⑧", "⑨", "⑩"],
    "map_symbol": ["A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "L", "M", "N"],
}
#: Other spellings of an answer: the number without its ring.
SPELLINGS = {"what_doing": [str(i) for i in range(1, 11)]}

# The words that a wording of each letter's category is expected to hold.
PAIRS = [("symbol", "where"), ("map_symbol", "location_name")]
PAIR_WORDS = {
    "symbol": {
        "あ": ["道", "駐車"],
        "い": ["家", "ビル", "建物", "アパート", "マンション"],
        "う": ["木"],
        "え": ["木"],
        "お": ["葉"],
        "か": ["花"],
        "き": ["地面", "じめん", "土"],
        "く": ["池"],
        "け": [],
    },
    "map_symbol": {
        "A": ["住宅", "団地"],
        "B": ["学校", "小学", "中学", "高校"],
        "C": ["かだん", "花だん", "花壇"],
        "D": ["並木", "なみき"],
        "E": ["駐車", "パーキング"],
        "F": ["寺", "神社", "宮"],
        "G": ["公園", "庭園"],
        "H": ["駅"],
        "I": ["ビル"],
        "J": ["道路", "通り"],
        "K": ["公園"],
        "L": ["家", "自宅", "室内"],
        "M": ["川", "運河"],
        "N": ["緑地", "ビル"],
    },
}

# The code points that a Japanese sheet may hold, as inclusive ranges.
SCRIPTS = [(0x0020, 0x007E), (0x00B0, 0x00B0), (0x2460, 0x24FF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3200, 0x32FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF)]

# The marks, the towns and the species that the judgements go by.
MARKS = {"outside_minato": ["◎", "○", "△"], "target_species": ["◎", "○"]}
TOWNS = "芝公園 芝大門 芝 浜松町 海岸 東新橋 新橋 西新橋 虎ノ門 愛宕 三田 麻布台 麻布狸穴町 麻布永坂町 麻布十番 東麻布 元麻布 西麻布 南麻布 六本木 赤坂 元赤坂 北青山 南青山 高輪 白金 白金台 芝浦 港南 台場".split()
SPECIES = "オンブバッタ ショウリョウバッタモドキ ショウリョウバッタ カナブン アオドウガネ リュウキュウツヤハナムグリ コフキコガネ シロテンハナムグリ タマムシ ギンヤンマ コシアキトンボ オオシオカラトンボ シオカラトンボ ハラビロカマキリ コカマキリ オオカマキリ チョウセンカマキリ ナミアゲハ キアゲハ アカボシゴマダラ ヤマトシジミ ルリシジミ ツバメシジミ モンキアゲハ クロアゲハ ナガサキアゲハ ツマグロヒョウモン アオスジアゲハ".split()

# Ruling of the table and of the strip above it, as fractions of the page.
ROW_EDGES = [0.0364, 0.1526, 0.2712, 0.3877, 0.5055, 0.6227, 0.7406, 0.8582, 0.9764]
COLUMN_EDGES = [(0.0704, 0.2424), (0.2424, 0.2766), (0.2766, 0.4138), (0.4138, 0.5195), (0.5248, 0.5634), (0.5634, 0.6027), (0.6027, 0.6847), (0.6847, 0.7263), (0.7263, 0.8355), (0.8355, 0.8804), (0.8804, 0.9968)]
HEADER_BANDS = {"school": (0.0034, 0.8963, 0.1272, 0.9963), "grade": (0.1699, 0.8963, 0.2064, 0.9963), "school_class": (0.2196, 0.8963, 0.2538, 0.9963)}
V2_TABLE, V2_CANVAS = (3367, 1442), (3507, 1620)


def row_edges(sheet: str = "v1") -> list[float]:
    return ROW_EDGES if sheet == "v1" else [e * V2_TABLE[1] / V2_CANVAS[1] for e in ROW_EDGES]


def column_edges(sheet: str = "v1") -> list[tuple[float, float]]:
    return COLUMN_EDGES if sheet == "v1" else [(a * V2_TABLE[0] / V2_CANVAS[0], b * V2_TABLE[0] / V2_CANVAS[0]) for a, b in COLUMN_EDGES]


def _inside(*codes: int) -> dict[str, str]:
    """Each enclosed character with what it encloses, where Unicode says so."""
    return {chr(c): n for c in codes if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c)}


#: Width variants of digits and Latin letters, and ringed letters, kanji and kana: folded everywhere.
FOLDS = _inside(*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0x24B6, 0x24EA), *range(0x3280, 0x328A), *range(0x32D0, 0x32FF))
#: Ringed digits: folded in all but the number columns.
RINGED_DIGITS = _inside(*range(0x2460, 0x2474), 0x24EA) | {chr(start + i): str(i + 1) for start in (0x2776, 0x2780, 0x278A) for i in range(10)}

#: What Python strips: all white space, the ideographic space and the separators included.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_BREAKS = "\n\v\f\r\x1c\x1d\x1e\x85\u2028\u2029"


def script_class() -> str:
    """The allowed scripts as the inside of a regular expression's class."""
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in SCRIPTS)


def digit_class() -> str:
    """All characters that count as a digit in a header's number, as ranges: those with a digit value."""
    known = {c for c in range(0x110000) if chr(c).isdigit()}
    out = []
    for a in sorted(c for c in known if c - 1 not in known):
        b = a
        while b + 1 in known:
            b += 1
        out.append(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}")
    return "".join(out)

#: Names of groups, which are no species: the first four are fixed values, the others are those of the listed species' families.
GROUPS = ["カマキリ", "アゲハチョウ", "トンボ", "チョウノナカマ", "チョウ", "アゲハ", "カメムシ", "タマムシ類", "ヤンマ", "セミ", "バッタ", "クワガタ", "テントウムシ", "コガネムシ", "カミキリムシ", "ハチ", "アリ", "ガ", "シジミ", "タテハ"]
