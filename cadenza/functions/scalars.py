"""Column functions: pitches, titles, addresses, texts, times and grades."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Note names from C.
NOTES_EN = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
NOTES_JP = ["ド", "ド#", "レ", "レ#", "ミ", "ファ", "ファ#", "ソ", "ソ#", "ラ", "ラ#", "シ"]
# Least accuracy of the ratings perfect (3), great (2) and good (1); full and no credit, in semitones.
RATINGS = ((0.82, 3), (0.55, 2), (0.28, 1))
FULL, NONE = 0.75, 1.6
# Least score of each grade, least mean accuracy of each section's stamp.
GRADES = ((92.0, "殿堂入り!!"), (85.0, "プロ級!"), (75.0, "なかなか!"), (60.0, "まだまだ!"))
LOWEST_GRADE = "練習あるのみ!"
STAMPS = ((0.8, "すごい!!"), (0.55, "いいね!"), (0.3, "おしい…"))
LOWEST_STAMP = "がんばれ!"


def _steps(x: Column, steps, other) -> Column:
    out = F.when(x >= steps[0][0], steps[0][1])
    for least, value in steps[1:]:
        out = out.when(x >= least, value)
    return out.otherwise(other)


def note_name(midi: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, NOTES_EN)), F.pmod(midi, F.lit(12)).cast("int") + 1)
    return F.concat(name, (F.floor(midi / 12) - 1).cast("string"))


def note_name_jp(midi: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NOTES_JP)), F.pmod(midi, F.lit(12)).cast("int") + 1)


def midi_of(frequency: Column) -> Column:
    return 69 + 12 * F.log2(frequency / 440)


def half_up(x: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


def half_even(x: Column) -> Column:
    """The nearest whole number, halves to the even one."""
    return F.rint(x)


def folded(pitch: Column, target: Column) -> Column:
    """The pitch in the octave nearest to the target."""
    return pitch + 12 * half_up((target - pitch) / 12)


def credit(distance: Column) -> Column:
    """1 up to FULL semitones, 0 from NONE on, straight between."""
    return F.when(distance <= FULL, 1.0).when(distance <= NONE, (NONE - distance) / (NONE - FULL)).otherwise(0.0)


def rating(accuracy: Column) -> Column:
    return _steps(accuracy, RATINGS, 0)


def grade(score: Column) -> Column:
    return _steps(score, GRADES, LOWEST_GRADE)


def stamp(accuracy: Column) -> Column:
    return _steps(accuracy, STAMPS, LOWEST_STAMP)


def total_score(hit: Column, duration: Column) -> Column:
    """100 (hit / duration) ^ 0.7; null below half a second."""
    return F.when(duration >= 0.5, 100 * F.pow(hit / duration, F.lit(0.7)))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


# The forms of a karaoke video's title, of the English part in it, and of what may follow the artist.
TITLE = r"^【カラオケ練習用】([^／]+)／([^｜|]+)[｜|]\s*(.*)"
ENGLISH = r"^\[(?:Videoke|Karaoke)\]\s*([^-]+?)\s*-\s*(.+)"
AFTER_ARTIST = r"\s*-\s*カラオケ@DIVA.*$"


def title_parts(title: Column) -> Column:
    """title_jp, artist_jp, english_part, title_en, artist_en of a karaoke video's title; null where it has another form."""
    english = F.regexp_extract(title, TITLE, 3)
    artist = F.regexp_replace(F.regexp_extract(english, ENGLISH, 2), AFTER_ARTIST, "")
    return F.struct(_part(title, TITLE, 1).alias("title_jp"), _part(title, TITLE, 2).alias("artist_jp"), F.nullif(F.trim(english), F.lit("")).alias("english_part"), _part(english, ENGLISH, 1).alias("title_en"), F.nullif(F.trim(artist), F.lit("")).alias("artist_en"))


def video_id(url: Column) -> Column:
    """The eleven characters that name a video, from any common form of its address; else null."""
    u = F.trim(F.coalesce(url, F.lit("")))
    name = "[A-Za-z0-9_-]{11}"
    host = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rest = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?[^/?#]+(.*)$", 1)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    short = _part(path, rf"^/+({name})(?:/.*)?$")
    long = F.coalesce(_part(query, rf"(?:^|&)v=({name})(?:&|$)"), _part(path, rf"^/(?:embed|shorts|live|v)/({name})"))
    return F.when(u.rlike(rf"^{name}$"), u).when(host.isin("youtu.be", "www.youtu.be"), short).when(host.endswith("youtube.com") | host.endswith("youtube-nocookie.com"), long)


def ruby(marked: Column) -> Column:
    """The readings in a marked text, as base and reading: the run of Han characters, or what follows ｜, before 《…》."""
    pattern = r"(?:｜([^《》｜]+)|([\p{IsHan}々〆ヶ]+))《([^》]+)》"
    found = lambda i: F.regexp_extract_all(marked, F.lit(pattern), F.lit(i))
    return F.zip_with(F.zip_with(found(1), found(2), lambda a, b: F.concat(a, b)), found(3), lambda b, r: F.struct(b.alias("base"), r.alias("reading")))


def plain(marked: Column) -> Column:
    """A marked text without its readings."""
    return F.regexp_replace(F.regexp_replace(marked, r"《[^》]+》", ""), "｜", "")


def annotate(text: Column, readings: dict[str, str]) -> Column:
    """Known words of a text with their readings, the longest first."""
    import re

    words = sorted(readings, key=lambda w: (-len(w), w))
    if not words:
        return F.array().cast("array<struct<base:string,reading:string>>")
    found = F.regexp_extract_all(text, F.lit("(" + "|".join(map(re.escape, words)) + ")"), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in readings.items() for x in kv])
    return F.transform(found, lambda w: F.struct(w.alias("base"), F.element_at(known, w).alias("reading")))


def tidy(text: Column, most: int) -> Column:
    """White space single and trimmed, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def display_name(email: Column) -> Column:
    """What stands before the @, separators as spaces; `singer` if nothing is left."""
    own = F.trim(F.regexp_replace(F.regexp_extract(email, r"^([^@]*)", 1), r"[._+-]+", " "))
    return F.coalesce(F.nullif(tidy(own, 24), F.lit("")), F.lit("singer"))


def is_email(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def file_parts(path: Column) -> Column:
    """folder, stem and extension of a path."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.struct(F.regexp_extract(path, r"^(.*)[/\\]", 1).alias("folder"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r".(\.[^.]*)$", 1).alias("extension"))


def minutes(seconds: Column) -> Column:
    """m:ss, null for null."""
    s = seconds.cast("double")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(half_up(s % 60).cast("string"), 2, "0"))


def clock(seconds: Column) -> Column:
    """m:ss, empty for null or zero."""
    return F.when(F.coalesce(seconds.cast("double"), F.lit(0.0)) == 0, "").otherwise(minutes(seconds))


def slashed(day: Column) -> Column:
    """yyyy/MM/dd; years beyond 9999 or before 0 as they are, where the pattern alone would add a sign or zeros."""
    year = F.year(day)
    return F.when(year.between(0, 9999), F.date_format(day, "yyyy/MM/dd")).otherwise(F.concat(year.cast("string"), F.date_format(day, "/MM/dd")))


def ago(then: Column, now: Column) -> Column:
    """How long ago: s, m, h or d below 30 days, else the date."""
    s = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(then.cast("timestamp")) / 1e6
    n = lambda by, unit: F.concat(F.floor(s / by).cast("string"), F.lit(unit))
    return F.when(s < 60, "now").when(s < 3600, n(60, "m")).when(s < 86400, n(3600, "h")).when(s < 86400 * 30, n(86400, "d")).otherwise(F.date_format(then, "yyyy/MM/dd"))


def week_start(day: Column) -> Column:
    """The Sunday of a day's week."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address if there is one."""
    return F.coalesce(F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), peer)


def codec(log: Column) -> Column:
    return _part(log, r"Video: (\w+)")


def sweep_time(x: Column, t0: Column, rate: Column) -> Column:
    """When a sweep of `rate` pixels a second that began at t0 reaches x; sweep_place is its inverse."""
    return F.when(rate != 0, t0 + x / rate)


def sweep_place(t: Column, t0: Column, rate: Column) -> Column:
    return (t - t0) * rate


def tail(log: Column, more: Column, most: int = 40_000) -> Column:
    """A log with more text, its last characters."""
    return F.right(F.concat(F.coalesce(log, F.lit("")), F.coalesce(more, F.lit(""))), F.lit(most))


def lattice_place(row: Column, spacing: Column, phase: Column) -> Column:
    """Where a row of a lattice lies: the inverse of its row number, which counts upwards."""
    return phase - row * spacing


def shown_at(t_start: Column, begins: Column, ahead: float = 2.2) -> Column:
    """When a note comes into view: so many seconds ahead, but not before its page."""
    return F.greatest(t_start - ahead, begins)


def escaped(text: Column) -> Column:
    """A text as it may stand in HTML."""
    out = F.coalesce(text, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def stale(seen: Column, now: Column) -> Column:
    """Whether something was last seen in another hour than now."""
    return seen.isNull() | (F.date_trunc("hour", seen) != F.date_trunc("hour", now))


def overlaid(old: Column, new: Column) -> Column:
    """A map with the entries of another one put over its own."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def thinned(values: Column, step: int, most: int) -> Column:
    """Every step-th element of an array from the first on, so many at most."""
    return F.slice(F.filter(values, lambda x, i: i % step == 0), 1, most)
