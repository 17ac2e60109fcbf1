"""Column functions that fold the many spellings of rolls, slates, takes, days and times.

All are `Column -> Column` expressions inside the JVM; null and blank give null unless said.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for no sound roll, and container extensions of clips.
NO_SOUND_ROLL = ["N/A", "NONE", "NO", "MOS", "-", "FALSE"]
CLIP_EXTENSIONS = "mov|mxf|mp4|braw|ari|dng|r3d|wav"
#: Texts looked at for a date, and how late a filing still is a handover.
HEADER_CHARS, HANDOVER_HOURS = 1200, 48.0


def _clean(c: Column) -> Column:
    return F.upper(F.when(F.trim(c) != "", F.trim(c)))


def _int(c: Column) -> Column:
    """Digits without leading zeros, as text; null for no digits."""
    return F.when(c != "", F.regexp_replace(c, "^0+(?=[0-9])", ""))


def once(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def camera_roll(raw: Column) -> Column:
    """`A_0120_1EIC` to `A120`, `C1` to `C001`; what is no roll stays as upper case."""
    t = _clean(raw)
    digits = F.regexp_extract(t, r"^[A-Z][-_]?0*(\d+)", 1)
    return F.when(digits != "", F.concat(F.substring(t, 1, 1), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")))).otherwise(t)


def sound_roll(raw: Column) -> Column:
    """`SR_001` to `SR01`; recorder folders stay; dates and words for nothing are null."""
    t = _clean(raw)
    number = _int(F.regexp_extract(t, r"^(?:SR|R|SOUND)?[-_]?0*(\d{1,3})$", 1))
    return (
        F.when(t.isin(NO_SOUND_ROLL), None)
        .when(t.rlike(r"^\d{2}Y\d{2}M\d{2}$"), t)
        .when(t.rlike(r"^\d{6,8}$"), None)
        .when(t.rlike(r"^(?:SR|R|SOUND)?[-_]?0*\d{1,3}$"), F.concat(F.lit("SR"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))
        .when(t.contains("SR"), t)
    )


def slate(raw: Column) -> Column:
    """`27-7T01` to `27/7`; every spelling of a wild track to `49/WT`.

    The text is cut once: written out for each mention, it made methods that the JVM doesn't compile.
    """
    after, before = r"^(\+?[A-Z0-9]+)\s*[/_\s-]?\s*(?:WT|WILD)$", r"^(?:WT|WILD)\s*[/_\s-]?\s*(\+?[A-Z0-9]+)$"

    def without_take(t: Column) -> Column:
        bare_wild = t.startswith("WT") & ~t.contains("/") & ~t.contains("-")
        return F.when(bare_wild, t).otherwise(F.regexp_replace(t, r"(?<=[0-9/_-])T\d+$", ""))

    def of_text(t: Column) -> Column:
        halves = lambda mark: F.concat(F.trim(F.substring_index(t, mark, 1)), F.lit("/"), F.trim(F.substr(t, F.instr(t, mark) + 1)))
        return (
            F.when(t.rlike(after), F.concat(F.regexp_extract(t, after, 1), F.lit("/WT")))
            .when(t.rlike(before), F.concat(F.regexp_extract(t, before, 1), F.lit("/WT")))
            .when(t.isin("WT", "WILD"), "WT")
            .when(t.contains("/"), halves("/"))
            .when(t.contains("-"), halves("-"))
            .otherwise(t)
        )

    return once(once(F.regexp_replace(_clean(raw), r"WTT\d+$", "WT"), without_take), of_text)


def scene_compound(raw: Column) -> Column:
    """`21+25` and `73C-74AC` to arrays; null and blank to the empty array."""
    t = _clean(raw)
    plus = F.filter(F.transform(F.split(t, r"\+"), lambda x: F.trim(x)), lambda x: x != "")
    dash = F.transform(F.split(t, "-"), lambda x: F.trim(x))
    both = ~t.startswith("-") & (F.size(dash) == 2) & F.get(dash, F.lit(0)).rlike(r"\d") & F.get(dash, F.lit(1)).rlike(r"\d")
    return F.when(t.isNull(), F.array().cast("array<string>")).when(t.contains("+"), plus).when(t.contains("-") & both, dash).otherwise(F.array(t))


#: What take() returns.
TAKE = "struct<take_id:string,valid:boolean,starred:boolean,pickup:boolean,false_start:boolean,wild:boolean,vfx:boolean,mos:boolean,note:string>"


def _holds(words: tuple[str, ...], c: Column) -> Column:
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def names(text: Column, word: str) -> Column:
    """Whether a text holds a word of capitals, however it is written there; null for null.

    Upper case, which costs more than all else that is asked of a line, is made of texts beyond ASCII only.
    """
    return text.rlike(f"(?i){word}") | (text.rlike(r"[^\x00-\x7F]") & F.contains(F.upper(text), F.lit(word)))


def is_vfx(raw: Column) -> Column:
    return F.contains(F.upper(F.coalesce(raw, F.lit(""))), F.lit("VFX"))


def is_pickup(raw: Column) -> Column:
    return _holds(("PK", "P/U", "PICKUP"), F.upper(F.coalesce(raw, F.lit(""))))


def take(raw: Column) -> Column:
    """A free-text take to its id, flags and note: `T03*` to 3 starred, `02PK` to 2PK, `1.02` to 1.2.

    The text, what is left of it without marks, and its first token are each computed once; a bare
    number, which most takes are, has nothing to be looked for.
    """

    def result(take_id: Column, valid=True, starred=False, pickup=False, false_start=False, wild=False, vfx=False, mos=False, note=None) -> Column:
        values = (take_id, valid, starred, pickup, false_start, wild, vfx, mos, note)
        return F.struct(*[v if isinstance(v, Column) else F.lit(v) for v in values]).cast(TAKE)

    def of_text(t: Column) -> Column:
        bare = t
        for word in (r"\*", "CIRCLED", "CHOSEN", "PRINT", "STAR", "MOS", r"M\.O\.S", "MUTE", "SILENT"):
            bare = F.regexp_replace(bare, word, " ")
        bare = F.trim(F.regexp_replace(F.trim(bare), r"^(?:TAKE|TK)\s*", ""))
        bare = F.trim(F.regexp_replace(bare, r"^T(?=0*\d)", ""))
        return once(bare, lambda b: once(F.filter(F.split(b, r"\s+"), lambda x: x != ""), lambda tokens: once(F.coalesce(F.get(tokens, F.lit(0)), F.lit("")), lambda first: of_tokens(t, b, tokens, first))))

    def of_tokens(t: Column, bare: Column, tokens: Column, first: Column) -> Column:
        starred = _holds(("*", "CIRCLED", "CHOSEN", "PRINT", "STAR"), t)
        mos = _holds(("MOS", "M.O.S", "MUTE", "SILENT"), t)
        vfx, pickup = is_vfx(bare), is_pickup(bare)
        note = F.when(F.size(tokens) > 1, F.array_join(F.slice(tokens, 2, 10_000), " "))
        number = _int(F.regexp_extract(first, r"^(\d+)", 1))
        take_id = (
            F.when(first.rlike(r"^\d+\.\d+$"), F.concat(number, F.lit("."), _int(F.regexp_extract(first, r"\.(\d+)$", 1))))
            .when(first.rlike(r"^\d+$"), number)
            .when(first.rlike(r"^\d+(?:PK|P/U|PICKUP)$"), F.concat(number, F.when(pickup, "PK").otherwise("")))
            .when(first.rlike(r"^\d+[A-Z]+$"), F.concat(number, F.regexp_extract(first, r"([A-Z]+)$", 1)))
            .otherwise(first)
        )
        return F.when(first == "", result(F.lit(None), valid=False)).otherwise(result(take_id, starred=starred, pickup=pickup, vfx=vfx, mos=mos, note=note))

    def of_clean(t: Column) -> Column:
        wild = F.coalesce(_int(F.regexp_extract(t, r"(?:WT|WILD)\s*T?0*(\d+)", 1)), F.lit("1"))
        return (
            F.when(t.isNull(), result(F.lit(None), valid=False))
            .when((t == "FC") | t.contains("FALSE"), result(F.lit("FALSE"), valid=False, false_start=True))
            .when(t.startswith("WT") | t.startswith("WILD"), result(wild, wild=True))
            .otherwise(of_text(t))
        )

    def of_number(t: Column) -> Column:
        return result(_int(F.regexp_extract(t, r"^\d+", 0)), starred=t.endswith("*"))

    return once(F.trim(raw), lambda t: F.when(t.rlike(r"^\d+\*?\z"), of_number(t)).otherwise(once(_clean(t), of_clean)))


def shoot_day(raw: Column) -> Column:
    """`260728_SD31`, `D031`, `#31` to `31`."""
    t = _clean(raw)
    marked, digits = r"(?:SD|D|#)0*(\d+)", r"\b0*(\d+)\b"
    return (
        F.when(t.rlike(marked), _int(F.regexp_extract(t, marked, 1)))
        .when(t.rlike(r"^\d+$"), _int(t))
        .when(t.rlike(digits), _int(F.regexp_extract(t, digits, 1)))
        .otherwise(t)
    )


def _iso(day: Column, month: Column, year: Column) -> Column:
    d, m, y = (x.try_cast("int") for x in (day, month, year))
    y = F.when(y < 100, y + 2000).otherwise(y)
    return F.when(d.between(1, 31) & m.between(1, 12) & (y > 1900) & (y < 2200), F.format_string("%04d-%02d-%02d", y, m, d))


def shoot_date(text: Column, filename: Column) -> Column:
    """The date a document states and where: volume stamp, labelled header, header, file name."""
    header = F.substring(F.coalesce(text, F.lit("")), 1, HEADER_CHARS)
    name = F.coalesce(filename, F.lit(""))
    joined = F.concat(name, F.lit("\n"), header)
    stamp = r"(?i)\b(\d{2})(\d{2})(\d{2})_SD(\d+)\b"
    labelled = r"(?i)\bDATE\s*[:\-]?\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})\b"
    plain = r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?!\d)"
    dated = r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)"

    def claim(c: Column, pattern: str, order: tuple[int, int, int], source: str, day: Column | None = None) -> Column:
        parts = [F.regexp_extract(c, pattern, i) for i in order]
        date = _iso(*parts)
        out = F.struct(date.alias("date"), F.lit(source).alias("source"), (day if day is not None else F.lit(None).cast("string")).alias("shoot_day"))
        return F.when(date.isNotNull(), out)

    return F.coalesce(
        claim(joined, stamp, (3, 2, 1), "volume_stamp", _int(F.regexp_extract(joined, stamp, 4))),
        claim(header, labelled, (1, 2, 3), "labelled_header"),
        claim(header, plain, (1, 2, 3), "header"),
        claim(name, dated, (3, 2, 1), "filename"),
    )


def timecode_frames(tc: Column, fps: float = 24.0) -> Column:
    """Frames since midnight of `HH:MM:SS:FF` or `HH:MM:SS;FF`; non-drop."""
    pattern = r"^\s*(\d{2}):(\d{2}):(\d{2})[:;](\d{2})\s*$"
    h, m, s, f = (F.regexp_extract(tc, pattern, i).try_cast("bigint") for i in (1, 2, 3, 4))
    return F.when(tc.rlike(pattern), F.bround((h * 3600 + m * 60 + s) * F.lit(fps)).cast("bigint") + f)


def frame_drift(a: Column, b: Column, fps: float = 24.0) -> Column:
    return F.abs(timecode_frames(a, fps) - timecode_frames(b, fps))


def clip_stem(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), rf"(?i)\.({CLIP_EXTENSIONS})$", "")


def scene_and_shot(slate_: Column) -> Column:
    """struct(scene, shot): the half before the last separator and the shot's leading digits."""
    t, pattern = F.trim(F.coalesce(slate_, F.lit(""))), r"^(.+?)[/_ -]([^/_ -]+)$"
    scene = F.trim(F.regexp_extract(t, pattern, 1))
    digits = F.regexp_extract(F.regexp_extract(t, pattern, 2), r"^(\d+)", 1)
    return F.struct(F.when(scene != "", scene).alias("scene"), digits.try_cast("bigint").alias("shot"))


def shot_number(end: Column) -> Column:
    """The shot of a range's end, written `27/8` or `8`."""
    t = F.trim(F.coalesce(end, F.lit("")))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("bigint")).otherwise(scene_and_shot(t)["shot"])


def scene_of_slate(slate_: Column, scene: Column | None = None) -> Column:
    half = F.substring_index(slate_, "/", 1)
    return half if scene is None else F.coalesce(F.when(scene != "", scene), half)


def scene_numbers(target: Column) -> Column:
    """The scenes that a slate, shot or compound target names: with a digit, in order, once."""
    parts = F.split(F.upper(F.substring_index(F.coalesce(target, F.lit("")), "/", 1)), r"[+,&]")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.rlike(r"\d") & (x != "WT")))


def handle(raw: Column, blank: str = "") -> Column:
    t = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(t == "", blank).when(t.startswith("@"), t).otherwise(F.concat(F.lit("@"), t))


def target_id(kind: Column, raw: Column) -> Column:
    """Upper case; shots as slates, scenes as the half before the slash."""
    t = F.upper(F.trim(raw))
    return F.when(kind == "shot", slate(t)).when(kind == "scene", F.substring_index(t, "/", 1)).otherwise(t)


def production_id(raw: Column) -> Column:
    """Upper case, with underscores for white space; null for a blank."""
    t = F.upper(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.when(t != "", F.regexp_replace(t, r"\s+", "_"))


def wrap_moment(date: Column, time: Column) -> Column:
    """UTC moment of a wrap; before 06:00 it belongs to the next calendar day."""
    hour, minute = (F.regexp_extract(F.trim(time), r"^(\d{1,2}):(\d{1,2})(?::.*)?$", i).try_cast("int") for i in (1, 2))
    day = F.try_to_timestamp(F.trim(date), F.lit("yyyy-MM-dd"))
    moment = day + F.make_interval(days=F.when(hour < 6, 1).otherwise(0), hours=hour, mins=minute)
    return F.when(day.isNotNull() & hour.between(0, 23) & minute.between(0, 59), moment)


def micros(moment: Column) -> Column:
    """Microseconds since 1970; moments without a zone are read in the session's, UTC."""
    return F.unix_micros(moment.cast("timestamp"))


def lag_seconds(wrapped: Column, filed: Column) -> Column:
    """Signed; a filing before the wrap stays negative."""
    return micros(filed) / 1e6 - micros(wrapped) / 1e6


def classify_lag(seconds: Column, hours: float = HANDOVER_HOURS) -> Column:
    return F.when(seconds.isNull(), None).when(seconds <= hours * 3600, "handover").otherwise("backfill")


def hours_between(start: Column, end: Column) -> Column:
    """Hours, never below zero, to a tenth (half to even)."""
    return F.bround(F.greatest(F.lit(0.0), (micros(end) - micros(start)) / 3.6e9), 1)


def hour_boundaries(start: Column, end: Column) -> Column:
    """Hour marks between two moments: 10:59 to 11:01 is one."""
    return F.floor(micros(end) / 3_600_000_000) - F.floor(micros(start) / 3_600_000_000)


def size_bytes(text: Column) -> Column:
    """`5.51 GB` to bytes, by 1024."""
    pattern = r"(?i)^\s*([\d.,]+)\s*([KMGT]?)i?B?\s*$"
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return (F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double") * F.pow(F.lit(1024.0), power)).cast("bigint")


def split_slate_take(raw: Column) -> Column:
    """`21/1:4` to struct(21/1, 4), by the last colon; without a slate or a take all is the take."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    halves = r"(?s)^(.*):(.*)$"
    slate_, take_ = (F.trim(F.regexp_extract(t, halves, i)) for i in (1, 2))
    whole = t.rlike(halves) & (slate_ != "") & (take_ != "")
    return F.struct(F.when(whole, slate_).alias("slate"), F.when(whole, take_).otherwise(t).alias("take"))


def clean_roll_token(raw: Column) -> Column:
    """`#B004 +1` and `B 004` to `B004`; a cell without a roll stays as it is."""
    token = r"(?i)([A-Z])\s*_?\s*(\d{2,4})"
    cell = F.coalesce(raw, F.lit(""))
    return F.when(cell.rlike(token), F.concat(F.upper(F.regexp_extract(cell, token, 1)), F.regexp_extract(cell, token, 2))).otherwise(F.trim(cell))


def is_take_label(raw: Column) -> Column:
    """Short and beginning with a digit: what a slate field must look like."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    return (F.length(t) <= 20) & t.rlike(r"^\d")


def is_clip_name(raw: Column) -> Column:
    t = F.trim(F.coalesce(raw, F.lit("")))
    return (F.length(t) <= 120) & t.rlike(r"\d") & ~t.rlike(r"\s") & (t != "")


def json_text(payload: Column, key: str) -> Column:
    """A payload's text field, or '' where it is missing."""
    return F.coalesce(F.get_json_object(payload, f"$.{key}"), F.lit(""))


#: Fixed value: a cue of a transition between shots, as a whole line.
TRANSITION = (
    r"(?i)^(?:(?:SMASH|MATCH|DISSOLVE|JUMP|QUICK|HARD|TIME|FLASH|CROSS)?\s*CUT\s+TO(?:\s+BLACK|\s+WHITE)?"
    r"|FADE\s+(?:IN|OUT|TO\s+BLACK|TO\s+WHITE)|DISSOLVE\s+TO|INTERCUT)[:.]?$"
)


def character_name(raw: Column) -> Column:
    t = F.regexp_replace(F.upper(F.trim(raw)), r"\s*\([^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\s:.,;]+$", ""), r"'S VOICE$", ""))


#: What stands in capitals in a script without being a character.
NO_CHARACTERS = [
    "INT", "EXT", "DAY", "NIGHT", "POV", "CU", "WS", "CLOSE", "ANGLE", "THE", "AND",
    "WITH", "CUT TO", "FADE IN", "FADE OUT", "FADE TO", "DISSOLVE TO", "SMASH CUT",
    "MATCH CUT", "BACK TO", "CONTINUED", "SCENE", "TITLE", "SUPER", "INSERT",
    "MONTAGE", "END MONTAGE", "INTERCUT", "THE END", "OMITTED", "LATER",
    "CONTINUOUS", "MOMENTS LATER", "WRITTEN BY", "BY", "CUT TO BLACK", "FADE TO BLACK",
    "SMASH CUT TO", "MATCH CUT TO", "JUMP CUT TO", "QUICK CUT TO", "HARD CUT TO",
    "TIME CUT TO", "FLASH CUT TO", "CROSS CUT TO",
]


def is_no_character(name: Column) -> Column:
    return name.isin("", *NO_CHARACTERS)


def is_transition(raw: Column) -> Column:
    """A line that is a cue and nothing else, whatever marks stand around it: a known one, or
    capitals that end in `TO:` or in a fade to black or white."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[#*_\s>]+|[#*_\s<]+$", "")
    capitals = (t == F.upper(t)) & (t != F.lower(t))
    return t.rlike(TRANSITION) | (capitals & t.rlike(r"TO:$|TO BLACK\.$|TO WHITE\.$"))


#: Sizes, angles and movements of a shot, the phrases that name each, and short forms.
SHOT_SIZES = [
    ("ECU", ["extreme close-up", "extreme close up", "macro"], "ecu"), ("CU", ["close-up", "close up", "tight on"], "cu"),
    ("MCU", ["medium close-up", "medium close up"], "mcu"), ("OTS", ["over-the-shoulder", "over the shoulder"], "ots"),
    ("EWS", ["extreme wide", "panoramic"], "ews"), ("WS", ["wide shot", "wide angle", "master shot", "establishing"], "ws"),
    ("MWS", ["medium wide", "cowboy"], "mws"), ("POV", ["point of view"], "pov"), ("INSERT", ["insert", "cutaway", "detail"], ""),
]
SHOT_ANGLES = [
    ("LOW_ANGLE", ["low angle", "looking up", "worm's eye"], ""), ("HIGH_ANGLE", ["high angle", "looking down", "overhead", "bird's eye", "bird view"], ""),
    ("DUTCH_ANGLE", ["dutch", "tilted", "canted"], ""),
]
SHOT_MOVEMENTS = [
    ("HANDHELD", ["handheld", "shaky"], ""), ("DOLLY_IN", ["dolly in", "push in", "tracking"], ""), ("DOLLY_OUT", ["dolly out", "pull back", "pull out"], ""),
    ("SLIDER", ["slider", "glide"], ""), ("STEADICAM", ["steadicam"], ""), ("CRANE", ["crane", "jib"], ""), ("PAN_TILT", ["pan", "tilt"], ""),
]


def _first_named(text: Column, names: list[tuple[str, list[str], str]], otherwise: Column) -> Column:
    out = otherwise
    for label, phrases, short in reversed(names):
        named = _holds(tuple(phrases), text)
        out = F.when(named | text.rlike(rf"\b{short}\b") if short else named, label).otherwise(out)
    return out


def shot_size(text: Column, has_dialogue: Column | None = None, first: Column | None = None) -> Column:
    """struct(size, angle, movement) that a shot's description names, by the first rule that fits.

    A shot that names no size is wide if it opens a scene without dialogue, and medium otherwise.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    opens = (first if first is not None else F.lit(False)) & ~(has_dialogue if has_dialogue is not None else F.lit(False))
    size = _first_named(t, SHOT_SIZES, F.when(opens, "WS").otherwise("MS"))
    return F.struct(size.alias("size"), _first_named(t, SHOT_ANGLES, F.lit("EYE_LEVEL")).alias("angle"), _first_named(t, SHOT_MOVEMENTS, F.lit("STATIC")).alias("movement"))


#: Words too common to anchor a passage, and shorthand of how a shot was taken.
COMMON_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "hers", "him", "his", "how", "in",
    "into", "is", "it", "its", "of", "on", "onto", "or", "our", "out", "over", "she", "so", "that", "the", "their", "them", "then", "there", "these",
    "they", "this", "to", "up", "was", "we", "were", "what", "when", "where", "which", "who", "will", "with", "you", "your",
]
LOG_SHORTHAND = [
    "abandoned", "again", "alt", "angle", "camera", "cam", "circled", "close", "complete", "cont", "contd", "continued", "cover", "coverage", "cu",
    "cut", "day", "ecu", "end", "ext", "false", "good", "insert", "int", "lens", "mcu", "mos", "ms", "mws", "night", "note", "ots", "pickup",
    "pov", "printed", "reset", "roll", "scene", "scenes", "series", "setup", "shot", "shots", "slate", "sound", "start", "tail", "take", "takes",
    "top", "vfx", "wide", "wild", "wt", "ws",
]


def anchor_terms(text: Column) -> Column:
    """Words of three letters or more that could anchor a passage, in order, repeats included."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z'’-]{2,}"), F.lit(0))
    plain = F.transform(words, lambda w: F.regexp_replace(F.translate(F.lower(w), "’", "'"), r"^['-]+|['-]+$", ""))
    return F.filter(plain, lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_WORDS, *LOG_SHORTHAND))


def clean_note(raw: Column) -> Column:
    t = F.regexp_replace(raw, r"(?i)^\s*day\s*:?\s*\d+\s*", "")
    t = F.regexp_replace(t, r"\b\d{1,2}:\d{2}(?::\d{2}(?:[:;]\d{2})?)?\b", "")
    t = F.regexp_replace(t, r"(?i)scene\(s\):\s*\S+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^[\s>→-]+", ""), r"\s+", " "))


#: Words that fill a description, placeholders, what a camera could resolve, and the
#: words that a field needs.
VAGUE_TERMS = [
    "cinematic", "expressive", "distinctive", "distinguishing", "striking", "mysterious", "intense", "rugged", "appropriate", "suitable", "typical",
    "generic", "various", "certain", "undefined", "unspecified", "presence", "characterful", "compelling", "memorable", "interesting", "unique",
    "somewhat", "perhaps", "possibly", "likely", "maybe", "tbd",
]
PLACEHOLDERS = r"(?i)to be (?:defined|determined|decided)|not (?:described|specified|stated)|refine to lock|consistent across|set a reference|tbd|unknown|n/a|placeholder|lorem ipsum"
CONCRETE = (
    r"(?i)\b\d+s?\b|'\d|\b(?:black|white|grey|gray|brown|blue|green|red|amber|navy|olive|tan|blonde|charcoal|cream|rust|ochre|auburn|ginger|silver|gold|"
    r"wool|cotton|linen|leather|denim|silk|canvas|tweed|velvet|corduroy|nylon|suede|rubber|brass|steel|plastic|fur|"
    r"scar|freckle|stubble|mole|tattoo|beard|braid|ponytail|moustache|hair|eyes|eye|cheekbone|cheekbones|jaw|jawline|brow|chin|nose|lips|mouth|"
    r"skin|complexion|shoulders|build|frame|hands|posture|collar|cuff|cuffs|button|buttons|zip|lapel|hem|seam|pocket|"
    r"boot|boots|glove|gloves|coat|jacket|shirt|dress|trousers|skirt|vest|scarf|belt|hat|cap|apron|uniform|tie|watch|ring|chain|"
    r"frayed|torn|patched|stained|faded|worn|creased|cracked|scuffed|bleached)\b"
)
LEAST_WORDS = {"actor_reference": 10, "look_and_costume": 12, "facial_features": 10}


def is_vague(text: Column, field: str = "") -> Column:
    """Blank, with a filler or a placeholder; and of a described field, too short or nothing concrete."""
    t = F.coalesce(text, F.lit(""))
    filler = F.lower(t).rlike(rf"(?<![a-z])(?:{'|'.join(VAGUE_TERMS)})(?![a-z])")
    vague = ~t.rlike(r"\S") | filler | t.rlike(PLACEHOLDERS)
    if field in LEAST_WORDS:
        words = F.size(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+"))
        vague = vague | (words < LEAST_WORDS[field]) | ~t.rlike(CONCRETE)
    return vague
