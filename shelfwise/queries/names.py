"""Name queries; names are made from parts and line items, so that every pattern occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import names
from shelfwise.operators import ordering
from shelfwise.registry import query, read

_RAW = """case p_partkey % 7 when 0 then p_name || ': ' || p_brand when 1 then p_brand || '/' || p_name when 2 then '<' || p_name || '>?' when 3 then 'con' when 4 then '"' || p_name || '" | ' || p_brand || '…'
  when 5 then ' . ' else p_name || '. . ' end || case when p_size % 9 = 0 then repeat(' long name', 20) else '' end"""


def _clean(profile):
    p = names.PROFILES[profile]
    out = _RAW
    for bad, good in p["swaps"].items():
        out = f"replace({out}, {_sql(bad)}, {_sql(good)})"
    out = f"trim(regexp_replace(regexp_replace({out}, '[<>:\"/\\\\|?*]', '', 'g'), '\\s+', ' ', 'g'))"
    out = f"regexp_replace({out}, '{'^[ .]+|[ .]+$' if profile == 'segment' else '[. ]+$'}', '', 'g')"
    if p["reserved"]:
        out = f"case when lower({out}) = 'con' then {_sql('con_' if p['reserved'] == 'after' else '_con')} else {out} end"
    if p["limit"]:
        out = f"substr({out}, 1, {p['limit']})"
        out = out if profile == "segment" else f"regexp_replace({out}, '[. ]+$', '')"
    return f"case when {out} = '' then {_sql(p['empty'])} else {out} end as {profile}"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"select p_partkey, {', '.join(map(_clean, names.PROFILES))} from part")
def sanitize_profiles(spark, d):
    """Names made safe by each profile."""
    rows = read(spark, d, "part").select("p_partkey", F.expr(_RAW).alias("raw"))
    return rows.select("p_partkey", *[names.sanitized(F.col("raw"), p).alias(p) for p in names.PROFILES])


_SHOWN = "case p_partkey % 6 when 0 then concat('  ', p_name, ' (', p_brand, ')') when 1 then '??' when 2 then concat(p_name, ': \u00e9t\u00e9 & co.') when 3 then concat(p_name, '   _', p_type, '-1.') when 4 then '<a|b>/c*' else '' end"


@query(f"""
with n as (select p_partkey, {_SHOWN} as name from part)
select p_partkey, coalesce(nullif(regexp_replace(trim(regexp_replace(name, '[^A-Za-z0-9 ._-]', '', 'g')), '\\s+', ' ', 'g'), ''), 'show') as folder,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(name, ':', ' - '), '/', ' '), '|', '-'), '<', '('), '>', ')'), '?', ''), '*', ''), '\\s+', ' ', 'g')) as file from n
""")
def other_sanitizers(spark, d):
    """Folder names for downloads, and names of sidecars that a sweep moves."""
    rows = read(spark, d, "part").select("p_partkey", F.expr(_SHOWN).alias("name"))
    return rows.select("p_partkey", names.show_folder(F.col("name")).alias("folder"), names.swept_name(F.col("name")).alias("file"))


@query("""
select p_partkey, case when p_size > 45 then '' else p_name || ' (' || (1950 + p_size) || ') {imdb-tt' || lpad(p_partkey::varchar, 7, '0') || '}' end as folder,
  case when p_size % 10 = 0 then 'Specials' else 'Season ' || lpad((p_size % 10)::varchar, 2, '0') end as season,
  'S' || lpad((p_size % 10)::varchar, 2, '0') || 'E' || case when p_partkey % 150 < 10 then '0' else '' end || (p_partkey % 150)
    || case when p_partkey % 3 = 0 then '-E' || case when p_partkey % 150 + 1 < 10 then '0' else '' end || (p_partkey % 150 + 1) else '' end as key
from part
""")
def target_templates(spark, d):
    """Folders, seasons and episode keys by template."""
    episode = F.col("p_partkey") % 150
    year = F.when(F.col("p_size") <= 45, 1950 + F.col("p_size"))
    imdb = F.concat(F.lit("tt"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    season = F.col("p_size") % 10
    key = names.episode_key(season, episode, F.when(F.col("p_partkey") % 3 == 0, episode + 1))
    return read(spark, d, "part").select("p_partkey", names.movie_target(F.col("p_name"), year, imdb).alias("folder"), names.season_folder(season).alias("season"), key.alias("key"))


_ARTISTS = "case c_custkey % 6 when 0 then 'The ' || c_mktsegment when 1 then lower(c_mktsegment) when 2 then cast(c_custkey as string) || ' men' when 3 then 'éa' when 4 then '  Los ' || c_name else ' ' end"


@query(rf"""
with a as (select c_custkey, trim(regexp_replace(trim({_ARTISTS}), '^(the|a|an|el|la|los|las|les)\s+', '', 'i')) as name from customer)
select c_custkey, case when name = '' then '_Unknown' when regexp_matches(upper(name[1]), '[A-Z]') then upper(name[1]) when regexp_matches(name[1], '[0-9]') then '0-9' else '_Other' end as letter from a
""")
def letter_bucket(spark, d):
    """Letters to file artists under."""
    return read(spark, d, "customer").select("c_custkey", names.letter(F.expr(_ARTISTS)).alias("letter"))


@query("""
select p_partkey, row_number() over (order by ltrim(ltrim(lower(p_name), 'the '), 'a '), p_partkey)::int as place from part
""")
def article_sort(spark, d):
    """Places in a list that sorts without articles."""
    rows = read(spark, d, "part").select("p_partkey", names.article_sort_key(F.col("p_name")).alias("key"))
    return ordering.running(rows, [F.col("key"), F.col("p_partkey")]).select("p_partkey", F.col("place").cast("int").alias("place"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(dense_rank() over (order by l_shipdate, l_returnflag) as bigint) as batch_id from lineitem")
def dense_ids(spark, d):
    """Numbers without gaps for dates and flags, in their order."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    return ordering.dense(lines, ["l_shipdate", "l_returnflag"], "batch_id").drop("l_shipdate", "l_returnflag")


_NAME = """case l_orderkey % 12 when 0 then 'My.Show.S' || cast(l_partkey % 30 as string) || 'E0' || cast(l_linenumber as string) || '.720p.mkv' when 1 then 'My Show ' || cast(l_partkey % 30 as string) || 'x0' || cast(l_linenumber as string) || '.avi'
  when 2 then 'Episode ' || cast(l_linenumber as string) || '-' || cast(l_suppkey % 9 as string) || '.mp4' when 3 then cast(l_linenumber as string) || ' - Name.mkv' when 4 then 'show s01 e' || cast(l_linenumber as string) || '-E' || cast(l_suppkey % 9 as string) || ' x264.mkv'
  when 5 then '1999 story ' || cast(l_suppkey as string) || ' 1080p.mkv' when 6 then '2x03-2x0' || cast(l_linenumber as string) || '.mkv' when 7 then 'Christmas Special.E' || cast(l_suppkey as string) || '.mkv' when 8 then 'h264 2001.mkv'
  when 9 then 'Show3x4b s1e2c.mkv' when 10 then 'Ep.' || cast(l_suppkey as string) || ' behind the scenes.mkv' else 'Nothing here.mkv' end"""
_SEASON = "case l_partkey % 5 when 0 then 'Specials' when 1 then 'Season ' || cast(l_partkey % 30 as string) when 2 then 'season 07 (2004)' when 3 then 'Season' else 'Season ' || cast(l_partkey % 12 as string) end"


@query(rf"""
with n as (select l_orderkey, l_linenumber, l_partkey, {_NAME} as name, lower(regexp_replace(name, '\.[a-zA-Z0-9]{{2,4}}$', '')) as low, lower({_SEASON}) as of from lineitem),
p as (select *, case when regexp_matches(of, '^\s*specials?\s*(\([0-9]{{4}}\))?\s*$') then 0 else try_cast(regexp_extract(of, '^\s*season\s*([0-9]{{1,3}})\s*(?:\([0-9]{{4}}\))?\s*$', 1) as int) end as fs,
  regexp_extract(low, '(?:^|[^a-z0-9])s([0-9]{{1,3}})[\s._-]?e([0-9]{{1,4}})(?:[\s._-]*[e-][\s._-]*([0-9]{{1,4}}))?(?:[^a-z0-9]|$)', ['s', 'e', 'l']) as a,
  regexp_extract(low, '(?:^|[^a-z0-9])([0-9]{{1,3}})x([0-9]{{1,4}})(?:[\s._-]*-[\s._-]*(?:[0-9]{{1,3}}x)?([0-9]{{1,4}}))?(?:[^a-z0-9]|$)', ['s', 'e', 'l']) as b,
  regexp_extract(low, '(?:^|[^a-z0-9])(?:episode|ep|e)[\s._-]*([0-9]{{1,4}})(?:[\s._-]*-[\s._-]*([0-9]{{1,4}}))?(?:[^a-z0-9]|$)', ['e', 'l']) as w,
  [z for z in [try_cast(y as int) for y in string_split_regex(low, '[^a-z0-9]+') if regexp_full_match(y, '[0-9]{{1,4}}')] if z < 1900 or z > 2099][1] as bare from n),
r as (select *, case when a.e <> '' then 's_e' when b.e <> '' then 'x_form' when fs is not null and w.e <> '' then 'season_ep' when fs is not null and bare is not null then 'season_bare' end as pattern from p),
v as (select *, case pattern when 's_e' then try_cast(a.s as int) when 'x_form' then try_cast(b.s as int) else fs end as season, case pattern when 's_e' then try_cast(a.e as int) when 'x_form' then try_cast(b.e as int) when 'season_ep' then try_cast(w.e as int) else bare end as episode,
  try_cast(case pattern when 's_e' then a.l when 'x_form' then b.l when 'season_ep' then w.l end as int) as upto from r)
select l_orderkey, l_linenumber, l_partkey, name, pattern, case when pattern is not null then season end as season, case when pattern is not null then episode end as episode, case when upto > episode then upto end as last,
  case pattern when 's_e' then case when upto > episode then 90 else 95 end when 'x_form' then case when upto > episode then 82 else 88 end when 'season_ep' then case when upto > episode then 75 else 80 end when 'season_bare' then 65 end::int as confidence,
  case when pattern is not null then coalesce(season = 0 or regexp_matches(low, '\b(?:specials?|ova|oad|extras?|christmas|holiday|new ?year|behind the scenes|making of|deleted scenes?|gag reel|bloopers?)\b'), false) end as special,
  case when pattern is not null then coalesce(upto < episode, false) end as falling from v
""")
def episode_parse(spark, d):
    """Episodes out of names, every pattern."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_NAME).alias("name"), F.expr(_SEASON).alias("folder"))
    rows = names.with_episode(lines, F.col("name"), F.col("folder"), "e")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "name", "e.*")


#: Names of folders in many shapes; `h` is a token that five neighbours share.
_FOLDERS = """case when p_partkey % 5 = 0 and floor(p_partkey / 5) % 3 <> 0 then '0' || cast(p_size % 9 as string) || ' ' when p_partkey % 11 = 1 then 'Disc 2 T00 ' when p_partkey % 11 = 2 then '[grp] ' when p_partkey % 11 = 3 then '_Title12 '
    when p_partkey % 11 = 4 then '12 - ' else '' end || case p_partkey % 5 when 0 then '' when 3 then p_brand || ' ' else replace(substr(p_name, 1, 4), ' ', '') || '_' end
  || 'k' || substr(md5(cast(cast(floor(p_partkey / 5) as int) as string)), 1, 8) || case p_partkey % 13 when 0 then ' (1999)' when 1 then ' (2004-2010)' when 2 then '.1080p' when 3 then ' [HD]' when 4 then '.WEB-DL.x264-RARBG' when 5 then ' Complete Series'
    when 6 then ' - Season 2' when 7 then ' Dolby Vision HDR10+ 5.1' when 8 then ' (2001 - )/' else '' end"""
_QUALITY = "(^|[^\\w'])(?:" + "|".join(names.QUALITY_TAGS) + ")($|[^\\w'])"
_STOP = ", ".join(f"'{w}'" for w in names.STOP_WORDS)


def tokens_sql(name: str) -> str:
    """The rule of folder_tokens in RE2, which has no lookaround: boundaries are consumed, so each step runs twice or more."""
    out = f"trim(regexp_replace({name}, '[\\\\/\\s]+$', ''))"
    out = f"regexp_replace(regexp_replace({out}, '{names.YEARS}', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(\\w)[._]+(\\w)', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '^(?:{'|'.join(names.LEADING_MARKS)})+', '', 'i')"
    for _ in range(4):
        out = f"regexp_replace({out}, '{_QUALITY.replace(chr(39), chr(39) * 2)}', '\\1 \\2', 'gi')"
    return f"[t for t in string_split_regex(lower({out}), '[^a-z0-9]+') if length(t) > 1 and t not in ({_STOP})]"


@query(f"select p_partkey, array_to_string({tokens_sql('f')}, ' ') as tokens from (select p_partkey, {_FOLDERS} as f from part)")
def folder_tokens(spark, d):
    """Telling words of folder names."""
    return read(spark, d, "part").select("p_partkey", F.array_join(names.folder_tokens(F.expr(_FOLDERS)), " ").alias("tokens"))


@query(f"select doc_id, md5(array_to_string({tokens_sql('text')}, ' ')) as tokens from documents where text is not null")
def text_tokens(spark, d):
    """The same over whole texts, by digest."""
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.array_join(names.folder_tokens(F.col("text")), " ")).alias("tokens"))


_EPISODES = """case l_orderkey % 6 when 0 then 'My.' || l_shipmode_ || '.S01E0' || cast(l_linenumber as string) || '.720p.mkv' when 1 then l_shipmode_ || '_' || cast(l_suppkey as string) || ' 3x07 End.avi'
  when 2 then 'Ep ' || cast(l_linenumber as string) || ' ' || l_shipmode_ || '.mp4' when 3 then '[ax] ' || l_shipmode_ || ' (1999) - Episode 4.mkv' when 4 then l_shipmode_ || ' 1080p WEB-DL s2 e11.mkv' else l_shipmode_ || '.x265.mkv' end""".replace("l_shipmode_", "case when l_returnflag = 'R' then 'Blue Sky' when l_returnflag = 'A' then 'Hot.Gear' else 'Nine-Lives' end")


@query(rf"""
with f as (select l_orderkey, l_linenumber, l_partkey, {_EPISODES} as name from lineitem),
a as (select *, regexp_replace(regexp_replace(name, '\.[a-zA-Z0-9]{{2,4}}$', ''), '(\w)[._]+(\w)', '\1 \2', 'g') as n from f),
b as (select *, regexp_replace(n, '(?is)(^|[^a-z0-9])(?:s[0-9]{{1,3}}[\s._-]?e[0-9]{{1,4}}|[0-9]{{1,3}}x[0-9]{{1,4}}|(?:episode|ep|e)[\s._-]*[0-9]{{1,4}})([^a-z0-9].*)?$', '\1') as h from a),
c as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\[[^\]]*\]', ' ', 'g'), '{_QUALITY.replace(chr(39), chr(39) * 2)}', '\1 \2', 'gi'), '{_QUALITY.replace(chr(39), chr(39) * 2)}', '\1 \2', 'gi'), '{names.YEARS}', ' ', 'g') as q from b)
select l_orderkey, l_linenumber, l_partkey, regexp_replace(regexp_replace(q, '[-_.\s]+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g') as series from c
""")
def series_from_name(spark, d):
    """The series that each episode's name states."""
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", names.series_name(F.expr(_EPISODES)).alias("series"))


@query("select p_partkey, case when p_partkey % 2000 between 0 and 1899 then p_partkey % 2000 end::int as number from part")
def leading_number(spark, d):
    """Numbers in front of names that are no years."""
    name = F.concat((F.col("p_partkey") % 2000).cast("string"), F.lit(" - "), "p_name")
    return read(spark, d, "part").select("p_partkey", names.leading_number(name).alias("number"))


@query("""
select p_partkey, case p_partkey % 4 when 0 then 'Extended Cut' when 1 then 'Director''s Cut' when 2 then 'Fan' end as variant,
  p_name as title, lpad((p_partkey % 20)::varchar, 2, '0') as track, (1990 + p_size)::int as year from part
""")
def tag_cleaning(spark, d):
    """Variants, cleaned titles, track numbers and years of tags."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(".extended.cut"))).when(k == 1, "x.directors.cut").when(k == 2, "{edition-Fan} extended").otherwise("p_name")
    title = F.concat("p_name", F.lit(" (live (at [home])) feat. someone"))
    track, date = F.concat((F.col("p_partkey") % 20).cast("string"), F.lit("/20")), F.concat((1990 + F.col("p_size")).cast("string"), F.lit("-01-02"))
    return read(spark, d, "part").select("p_partkey", names.variant(name).alias("variant"), names.cleaned(title).alias("title"), names.track_of(track).alias("track"), names.year_of(date).alias("year"))


_RIPS = """case p_partkey % 8 when 0 then '03 - ' || p_name || ' (1971)' when 1 then upper(replace(p_name, ' ', '_')) || '_T00' when 2 then replace(p_name, ' ', '.') || '.1999.mkv' when 3 then p_name || ' Title1 T02.mkv'
  when 4 then '1994 - ' || p_name when 5 then '1946 - ' || p_name || ' 2003' when 6 then p_name || '-Playlist_800' else 'THE_' || upper(replace(p_name, ' ', '_')) end"""


@query(rf"""
with r as (select p_partkey, regexp_replace({_RIPS}, '(?i)\.[a-z0-9]{{1,4}}$', '') as n from part),
c as (select *, regexp_replace(n, '[^A-Za-z]', '', 'g') as letters from r),
t as (select p_partkey, case when length(letters) >= 4 and letters = upper(letters) and contains(n, '_') then array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(n, '_', ' '), ' ')], ' ') else n end as n from c),
u as (select p_partkey, regexp_replace(n, '(?i)(?:[-_\s]+(?:t[0-9]{{2,3}}|title[\s_]*[0-9]+|playlist[\s_]*[0-9]+|disc[\s_]*[0-9]+)\s*)+$', '') as n from t),
v as (select p_partkey, n, try_cast(regexp_extract(n, '^([0-9]{{1,4}})\s*[-.]\s*(.+)$', 1) as int) as num, regexp_extract(n, '^([0-9]{{1,4}})\s*[-.]\s*(.+)$', 2) as tail from u),
w as (select p_partkey, case when num <= 99 or regexp_matches(tail, '\b(?:19|20)[0-9]{{2}}\b') then tail else n end as n from v),
x as (select p_partkey, n, regexp_replace(n, '[\s._(\[-]*\b(?:19|20)[0-9]{{2}}\b.*$', '') as head from w)
select p_partkey, trim(regexp_replace(case when head = '' then n else head end, '[._\s]+', ' ', 'g')) as title, try_cast(regexp_extract(n, '\b((?:19|20)[0-9]{{2}})\b', 1) as int) as year from x
""")
def guessed_titles(spark, d):
    """Title and year out of a rip's name."""
    return read(spark, d, "part").select("p_partkey", names.guessed_title(F.expr(_RIPS)).alias("g")).select("p_partkey", "g.title", "g.year")


_FILES = """case p_partkey % 7 when 0 then replace(p_name, ' ', '.') || '.S0' || cast(p_size % 9 as string) || 'E12.DvDRip.x264-FGT.mkv' when 1 then '[ax] ' || p_name || ' - 1x03 - the ' || p_name || ' 2001.avi'
  when 2 then '01 - ' || p_name || ' (720p) Part 4.mp4' when 3 then p_name || ' - Episode 5 PackBluRay.mkv' when 4 then p_name || ' Season 2 (1995) complete.mkv' when 5 then p_brand || ' s1-3 BDRip [x].mkv' else p_name || '_-_' || p_brand || ' ep 7.mkv' end"""
_RELEASE, _PARTS = ", ".join(f"'{t}'" for t in names.RELEASE_TOKENS), "|".join(names.RELEASE_PARTS)
_CRUFT, _CRUFT_PARTS = ", ".join(f"'{t}'" for t in names.EPISODE_CRUFT), "|".join(t.replace(".", "[.]") for t in names.EPISODE_CRUFT)


def _kept_sql(text: str, split: str, whole: str, parts: str, edges: str) -> str:
    low = f"regexp_replace(lower(t), '^[{edges}]+|[{edges}]+$', '', 'g')"
    return f"array_to_string([t for t in string_split_regex({text}, '{split}') if {low} <> '' and {low} not in ({whole}) and not regexp_matches({low}, '{parts}') and not regexp_matches({low}, '^[0-9]{{4,}}$')], ' ')"


def _folder_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace({text}, '[(\\[]?\\b(?:19|20)[0-9]{{2}}\\b[)\\]]?', ' ', 'g'), '[\\[({{][^\\])}}]*[\\])}}]', ' ', 'g')"
    out = f"trim(regexp_replace(regexp_replace({out}, '\\b(?:s|season|series|seasons)\\s*[0-9]+(?:[-–][0-9]+)?\\b', ' ', 'gi'), '[._\\s-]+', ' ', 'g'))"
    return _kept_sql(out, " ", _RELEASE, _PARTS, ".,()-")


@query(rf"""
with f as (select p_partkey, {_FILES} as f from part), s as (select *, regexp_replace(f, '\.[^.]*$', '') as stem from f)
select p_partkey, {_folder_sql("f")} as folder, try_cast(regexp_extract(f, '\b((?:19|20)[0-9]{{2}})\b', 1) as int) as year,
  {_folder_sql(r"regexp_replace(regexp_replace(stem, '(?is)\b(?:s[0-9]+e[0-9]+|season\s*[0-9]+|episode\s*[0-9]+|[0-9]+x[0-9]+|[0-9]{1,3}\b).*$', ''), '(?s)(?: - | — |_-_).*$', '')")} as hint,
  {_kept_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '[\[({][^\])}]*[\])}]', ' ', 'g'), '(?i)\b(?:s[0-9]+\s*-?\s*e[0-9]+|season\s*[0-9]+|episode\s*[0-9]+|ep\s*[0-9]+|[0-9]+x[0-9]+)\b', ' ', 'g'), '^\s*[0-9]{1,3}\s*[-.]\s*', ''), '^[\s_.-]+', '')", r"[\s_.-]+", _CRUFT, _CRUFT_PARTS, '.,()"-')} as title
from s
""")
def show_and_title_hints(spark, d):
    """What files say of their show, its year and their episode's title."""
    rows = read(spark, d, "part").select("p_partkey", F.expr(_FILES).alias("f"))
    folder = names.clean_folder(F.col("f"))
    return rows.select("p_partkey", folder["name"].alias("folder"), folder["year"].alias("year"), names.show_hint(F.col("f")).alias("hint"), names.title_hint(F.col("f")).alias("title"))


_STEMS = """p_name || case p_partkey % 9 when 0 then ' Extended Directors.Cut' when 1 then '.Directors_Cut 3D' when 2 then ' Ultimate Edition HOU' when 3 then ' {edition-fan made}' when 4 then ' Extended Edition Extra 2'
  when 5 then ' remastered Extras' when 6 then ' Unrated.3D.FSBS' when 7 then ' Extended Extra' else '' end"""
_VARIANT = " ".join(rf"when regexp_matches(s, '(?i)\b{p.replace(chr(39), chr(39) * 2)}\b') then '{v.replace(chr(39), chr(39) * 2)}'" for p, v in names.VARIANTS)


@query(rf"""
with n as (select p_partkey, {_STEMS} as s from part),
e as (select *, nullif(regexp_extract(s, '(?i)[{{]edition-([^}}]+)[}}]', 1), '') as tag, case {_VARIANT} end as marked, upper(nullif(regexp_extract(s, '(?i)\b(HSBS|FSBS|HOU|FOU)\b', 1), '')) as fmt,
  regexp_extract(s, '(?i)\b(Extras?)(?:\s+([0-9]+))?\s*$', 1) as mark, regexp_extract(s, '(?i)\b(Extras?)(?:\s+([0-9]+))?\s*$', 2) as num from n),
v as (select *, coalesce(array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(trim(replace(tag, '_', ' ')), ' ')], ' '), marked) as variant, coalesce(fmt, case when regexp_matches(s, '(?i)\b3D\b') then 'HSBS' end) as format from e)
select p_partkey, variant, format, case when num <> '' then 'Extra ' || num when lower(mark) = 'extras' then 'Extras' when mark <> '' then 'Extra' end as extra,
  case when variant is null then 'N {{{{imdb-x}}}}' else 'N {{{{edition-' || variant || '}}}} {{{{imdb-x}}}}' end || coalesce(' - 3D.' || format, '') as template from v
""")
def variants(spark, d):
    """The edition, the format in 3D and the kind of extra that a name states, and the template with them."""
    rows = read(spark, d, "part").select("p_partkey", F.expr(_STEMS).alias("s"))
    rows = rows.select("p_partkey", names.variant(F.col("s")).alias("variant"), names.format_3d(F.col("s")).alias("format"), names.extra_label(F.col("s")).alias("extra"))
    return rows.withColumn("template", names.variant_template(F.lit("N {{imdb-x}}"), F.col("variant"), F.col("format")))


#: Words as they are and as they look when their UTF-8 was read as Latin-1, some of them beyond repair.
_DAMAGED = "case c_custkey % 7 when 0 then concat('Caf\u00e9 ', c_name) when 1 then concat('Caf\u00c3\u00a9 ', c_name) when 2 then concat('\u00c3\u00a9 \u00c4 ', c_name) when 3 then concat('\u00c3\u00a9 \u4e2d ', c_name) when 4 then concat('Alegr\u00c3\u00ada ', c_name, ' \u00c2\u00bf') when 5 then concat('\u00c4\u00a9 ', c_name) else c_name end"


@query("""
select c_custkey, case c_custkey % 7 when 0 then concat('Caf\u00e9 ', c_name) when 1 then concat('Caf\u00e9 ', c_name) when 2 then concat('\u00c3\u00a9 \u00c4 ', c_name) when 3 then concat('\u00c3\u00a9 \u4e2d ', c_name) when 4 then concat('Alegr\u00eda ', c_name, ' \u00bf') when 5 then concat('\u00c4\u00a9 ', c_name) else c_name end as name from customer
""")
def repaired_names(spark, d):
    """Names whose letters were read in the wrong encoding, where that can be told and undone."""
    return read(spark, d, "customer").select("c_custkey", names.repaired(F.expr(_DAMAGED)).alias("name"))
