"""Which sport a listing is of, by its title, its series, its tags and its references: rules as data, tried source by source.
Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import bound, first_match

UNKNOWN = "unknown"

# Patterns of titles, and the sport of the first that is found.
TITLES = (
    (r"\bNFL\b|pro.?football|super.?bowl", "nfl"),
    (r"\bNBA\b|pro.?basketball|nba.?finals", "nba"),
    (r"\bMLB\b|pro.?baseball|world.?series", "mlb"),
    (r"\bNHL\b|pro.?hockey|stanley.?cup", "nhl"),
    (r"\bNCAAFB\b|college.?football|ncaa.?football", "ncaaf"),
    (r"\bNCAABB\b|college.?basketball|ncaa.?basketball|march.?madness", "ncaab"),
    (r"\bNCAAF?\b|\bNCAAB?\b|\bNCAAW?\b", "ncaa"),
    (r"\bUFC\b|\bMMA\b|mixed.?martial", "mma"),
    (r"league.?of.?legends|\bLoL\b|dota.?2|\bCS[:\s]?GO\b|\bCS2\b|valorant|overwatch|rocket.?league|starcraft|hearthstone", "esports"),
    (r"\bE.?SPORTS\b", "esports"),
    (r"\bUCL\b|champions.?league", "soccer"),
    (r"\bUEL\b|europa.?league", "soccer"),
    (r"\bUECL\b|conference.?league", "soccer"),
    (r"\bEPL\b|premier.?league", "soccer"),
    (r"\bFIFA\b|world.?cup", "soccer"),
    (r"\bMLS\b", "soccer"),
    (r"\bLA.?LIGA\b|laliga", "soccer"),
    (r"\bBUNDESLIGA\b", "soccer"),
    (r"\bSERIE.?A\b|seriea", "soccer"),
    (r"\bLIGUE.?1\b|ligue1", "soccer"),
    (r"\bA.?LEAGUE\b", "soccer"),
    (r"\bJ.?LEAGUE\b|j\.?league", "soccer"),
    (r"\bK.?LEAGUE\b", "soccer"),
    (r"\bLIGA.?PORTUGAL\b|primeira.?liga", "soccer"),
    (r"\bFA.?CUP\b|carabao|efl.?cup", "soccer"),
    (r"\bEREDIVISIE\b", "soccer"),
    (r"\bSCOTTISH.?PREM", "soccer"),
    (r"\bCOPA.?AMERICA\b|\bEURO.?20", "soccer"),
    (r"\bINTL?.?FRIENDLY\b|international.?friendly", "soccer"),
    (r"brasile[ir]+o", "soccer"),
    (r"ballon.?d.?or", "soccer"),
    (r"super.?lig\b", "soccer"),
    (r"\bBELGIAN.?(?:PRO.?LEAGUE|PL)\b", "soccer"),
    (r"\bAPF\b|division.?de.?honor", "soccer"),
    (r"copa.?del.?rey", "soccer"),
    (r"\bVEN.?FUT\b", "soccer"),
    (r"\bclub.?world", "soccer"),
    (r"\bsoccer\b|\bfootball\b", "soccer"),
    (r"\bF\.?C\b(?!\s*\d)|\bfootball\s+club\b", "soccer"),
    (r"\bSAUDI.?PRO.?LEAGUE\b|\bSAUDI.?PL\b", "soccer"),
    (r"\bNWSL\b|national.?women.?soccer", "soccer"),
    (r"\bUSL\b.{0,15}(?:championship|league|super)", "soccer"),
    (r"baller.?league", "soccer"),
    (r"thai.?league|thai.?premier", "soccer"),
    (r"conmebol.?lib|copa.?libertadores|copa.?sudamericana", "soccer"),
    (r"\bserie.?b\b", "soccer"),
    (r"super.?league.{0,15}greece|hellenic.?super", "soccer"),
    (r"pfa.{0,10}(?:player|award|year)", "soccer"),
    (r"china.?super.?league|chinese.?super|csl\b", "soccer"),
    (r"efl.?championship|efl.?promo", "soccer"),
    (r"di.?mayor|primera.?a\b", "soccer"),
    (r"argentino.?primera|arg.?primera", "soccer"),
    (r"\bKHL\b|kontinental.?hockey", "hockey"),
    (r"\bAHL\b|american.?hockey.?league", "hockey"),
    (r"\bliiga\b|finnish.?hockey", "hockey"),
    (r"swiss.?(?:national.?)?league.{0,10}hockey|nla\b", "hockey"),
    (r"euroleague\b|eurocup.{0,5}basketball", "basketball"),
    (r"\bACB\b.{0,15}(?:league|basketball|game|season)", "basketball"),
    (r"lnb.?elite|argentina.{0,15}basketball", "basketball"),
    (r"bsl.{0,10}basketball|basketball.?super.?league", "basketball"),
    (r"rainbow.?six|\bR6\b.{0,10}(?:siege|esport|game)", "esports"),
    (r"\bTENNIS\b|\bATP\b|\bWTA\b|wimbledon|french.?open|australian.?open|set.?winner", "tennis"),
    (r"\bGOLF\b|\bPGA\b|\bMASTERS\b|the.?masters|\bLIV\b", "golf"),
    (r"\bF1\b|FORMULA.?1|formula.?one", "f1"),
    (r"\bBOXING\b", "boxing"),
    (r"\bNASCAR\b|\bINDYCAR\b", "motorsport"),
    (r"\bWRESTL", "wrestling"),
    (r"\bB.?LEAGUE\b|japanese.?basketball", "basketball"),
    (r"\bCBA\b.{0,20}(?:game|match|basketball)", "basketball"),
    (r"\bNBL\b.{0,20}(?:game|match)", "basketball"),
    (r"\bNRL\b|national.?rugby.?league", "rugby"),
    (r"\bsuper.?league.?rugby\b|\brugby.?league\b|\bRUGBY\b", "rugby"),
)
# Patterns of series tickers, for titles that say nothing.
SERIES = (
    (r"LOLGAME|LOLESPORT|LOLESPORTS", "esports"),
    (r"JBLEAGUE", "basketball"),
    (r"CBAGAME", "basketball"),
    (r"NBLGAME", "basketball"),
    (r"STEPHDEAL", "nba"),
    (r"ATPSETWINNER|ATPGAMESPREAD|ATPGAME|WTASETWINNER|WTGAME|GRANDSLAMJ", "tennis"),
    (r"EXHIBITIONWOMEN|EXHIBITIONTENNIS", "tennis"),
    (r"ALEAGUE", "soccer"),
    (r"JLEAGUE", "soccer"),
    (r"KLEAGUE", "soccer"),
    (r"LIGAPORTUGAL", "soccer"),
    (r"UELSPREAD|UECL\b", "soccer"),
    (r"FACUP|CARABAO", "soccer"),
    (r"INTLFRIENDLY", "soccer"),
    (r"CLUBWC", "soccer"),
    (r"BRASILE[IR]+O", "soccer"),
    (r"BALLONDOR", "soccer"),
    (r"SUPERLIG(?!RUGBY)", "soccer"),
    (r"BELGIANPL", "soccer"),
    (r"VENFUT", "soccer"),
    (r"APFDDH", "soccer"),
    (r"COPADELREY", "soccer"),
    (r"WINSTREAKMANU", "soccer"),
    (r"IIHF", "hockey"),
    (r"T20FOUR|T20TOTAL|IPL\b|CRICKET|BBLT20", "cricket"),
    (r"TGLCHAMPION|KFTOUR", "golf"),
    (r"WOFSKATE|WONORDIC|WO[A-Z]+", "olympics"),
    (r"NRLCHAMP", "rugby"),
    (r"RUGBYESL|SUPERLIGRUGBY|SLRCHAMP", "rugby"),
    (r"NCAAFMAC|NCAAFBIG|NCAAFSEC|NCAAFACE|NCAAFSUN", "ncaaf"),
    (r"NCAAMBAE|NCAAMBBSOU|NCAAMBIG|NCAAMBSEC", "ncaab"),
    (r"ACCREG|ACCTOURN", "ncaab"),
    (r"NFLAFCNORTH|NFLNFCEAST|NFLAFCEAST|NFLNFCWEST|NFLAFCWEST|NFLAFCSOUTH|NFLNFCSOUTH", "nfl"),
    (r"RECORDNFLWORST|RECORDNFL", "nfl"),
    (r"NCAABASEBALL|GOLDENSPIKES", "baseball"),
    (r"HEISMAN|NCAAF(?!B?B)|NCAAF[A-Z0-9]+", "ncaaf"),
    (r"NCAALAX|\bLAX\b", "lacrosse"),
    (r"NHLPLAYOFF", "nhl"),
    (r"USL|EFL|UEL|EPL|LIGAMX|EKSTRAKLASA|PERLIGA|NEXTMANAGER|RONALDO|PREMCHAMP", "soccer"),
    (r"WNBADRAFT|NBAPLAYIN", "basketball"),
    (r"MOTOGP", "motorsport"),
    (r"RYDERCUP|PGAEAGLE|PGABOGEYFREE|PGAAGECUT", "golf"),
    (r"CHESS", "chess"),
    (r"MLB.*(WINNER|INNINGS)|KBO|NPB|CHIBA|HANSHIN|DRAGONS|BAYSTARS|EAGLES", "mlb"),
    (r"CS2MAP|CS2GAME", "esports"),
    (r"R6GAME|R6SIEGE", "esports"),
    (r"NBAGAME|NBA1H(?:WINNER)?", "nba"),
    (r"NFLTEAM[0-9A-Z]*", "nfl"),
    (r"NCAAMLAX|NCAALAXFINAL|LAXTEWAARATON", "lacrosse"),
    (r"SAUDIPL", "soccer"),
    (r"DIMAYOR", "soccer"),
    (r"KHLGAME", "hockey"),
    (r"THAIL[0-9]", "soccer"),
    (r"SERIEBGAME", "soccer"),
    (r"AFLGAME", "aussierules"),
    (r"BALLERLEAGUE", "soccer"),
    (r"CONMEBOLLIB|CONMEBOLSUD|CONMEBOL", "soccer"),
    (r"BSLGAME", "basketball"),
    (r"EUROLEAGUE", "basketball"),
    (r"ACBGAME", "basketball"),
    (r"LNBELITE", "basketball"),
    (r"CHNSLGAME", "soccer"),
    (r"NWSLGAME", "soccer"),
    (r"PSLGAME", "soccer"),
    (r"PFAPOY", "soccer"),
    (r"SLGREECE", "soccer"),
    (r"ARGLNB", "basketball"),
    (r"LIIGAGAME", "hockey"),
    (r"SWISSLEAGUE", "hockey"),
    (r"EFLCHAMPIONSHIP|EFLPROMO", "soccer"),
    (r"AHLGAME", "hockey"),
    (r"ARGPREMDIV", "soccer"),
    (r"URYPDGAME", "soccer"),
    (r"NCAABBGAME|NCAABBGS", "ncaab"),
    (r"KXMLBF5|KXMLBGAME|MLBF5TOTAL|MLBF5SPREAD", "mlb"),
    (r"ITFWMATCH|ITFWGAME", "tennis"),
    (r"ISLGAME", "soccer"),
    (r"ALLSVENSKANGAME", "soccer"),
    (r"HNLGAME", "soccer"),
    (r"KXDELGAME", "hockey"),
    (r"SHLGAME", "hockey"),
    (r"ABAGAME", "basketball"),
    (r"CHLLDP", "soccer"),
    (r"VTBGAME", "tennis"),
    (r"CBASPREAD", "ncaab"),
    (r"BALGAME", "soccer"),
    (r"MCGREGORFIGHTNEXT", "mma"),
    (r"ECULP", "soccer"),
    (r"NHLWEST|NHLEAST|NHLNORTH", "nhl"),
    (r"FRA14CHAMP", "soccer"),
    (r"SAILGP", "motorsport"),
    (r"KBLGAME", "basketball"),
    (r"NLGAME", "soccer"),
    (r"GBLGAME", "soccer"),
    (r"EKSTRAKLASAGAME", "soccer"),
    (r"TURKEYGAME|TURKSLGAME", "soccer"),
)
# Parts of tags, and the sport of the first that some tag holds.
TAGS = (
    ("nfl", "nfl"), ("super-bowl", "nfl"), ("nba", "nba"), ("mlb", "mlb"), ("world-series", "mlb"), ("nhl", "nhl"), ("stanley-cup", "nhl"), ("ncaa", "ncaa"),
    ("college-football", "ncaaf"), ("college-basketball", "ncaab"), ("ufc", "mma"), ("mma", "mma"), ("soccer", "soccer"), ("football", "soccer"),
    ("champions-league", "soccer"), ("premier-league", "soccer"), ("mls", "soccer"), ("la-liga", "soccer"), ("laliga", "soccer"), ("bundesliga", "soccer"),
    ("serie-a", "soccer"), ("seriea", "soccer"), ("ligue-1", "soccer"), ("ligue1", "soccer"), ("eredivisie", "soccer"), ("europa-league", "soccer"),
    ("conference-league", "soccer"), ("copa-libertadores", "soccer"), ("copa-sudamericana", "soccer"), ("saudi-pro-league", "soccer"), ("nwsl", "soccer"),
    ("brasileirao", "soccer"), ("tennis", "tennis"), ("golf", "golf"), ("liv-golf", "golf"), ("pga", "golf"), ("formula-1", "f1"), ("f1", "f1"),
    ("boxing", "boxing"), ("esports", "esports"), ("sports", "unknown"),
)
# Numbers of tags, by sport.
TAG_IDS = {
    "soccer": (
        "100100 100350 100977 101735 101772 101787 101988 102008 102070 102154 102448 102561 102562 102563 102564 102593 102604 102648 102649 102650 102651 102652 102763 102764 102765 "
        "102770 102771 103095 103886 780 1234 1494"
    ).split(),
    "tennis": "101232 102123".split(), "nhl": ["100088"], "nfl": "450 101680".split(), "nba": "28 745 101178".split(), "basketball": "102669 104349".split(), "mlb": ["678"],
    "hockey": "102907 102908".split(), "esports": ["65"],
}
# First parts of references to events, by sport.
REFS = {
    "soccer": (
        "mls nwsl epl uel uecl ucl cdr dfb ptc itc nlc cde fpd spl ere bra bra2 arg mex por nor den rus tur gtm egy1 per1 col1 col bol1 hr1 svk1 cze1 rou1 ukr1 j1100 j2100 j1 j2 lib sud isp grc el2"
    ).split(),
    "nhl": ["nhl"], "mlb": "mlb kbo".split(), "basketball": "bkcl bkvtb".split(), "esports": ["lol"],
}
# Parts of references, slugs and titles that name a soccer league.
LEAGUES = (
    "mls", "premier-league", "premier league", "epl", "la-liga", "la liga", "laliga", "bundesliga", "serie-a", "serie a", "ligue-1", "ligue 1", "eredivisie", "saudi-pro-league",
    "saudi pro league", "champions-league", "champions league", "europa-league", "europa league", "conference-league", "copa-libertadores", "copa libertadores",
    "copa-sudamericana", "copa sudamericana", "copa-del-rey", "nwsl", "brasileirao",
)
# Tags that stand for others; the last says nothing.
ALIASES = {
    "wwoh": "nhl", "bkfibaqeu": "nba", "basketball": "nba", "bkjpn": "basketball_jpn", "bkaba": "basketball_aba", "bkbbl": "basketball_bbl", "bkbsl": "basketball_bsl",
    "bkvtb": "basketball_vtb", "bkgr1": "basketball_greece", "euroleague": "euroleague", "j1-100": "soccer_j1", "j2-100": "soccer_j2", "ukr1": "soccer_ukraine",
    "cricipl": "cricket_ipl", "cricpsl": "cricket_psl", "cricket": "cricket", "itsb": None,
}


def _looked_up(table: dict[str, list[str]], key: Column) -> Column:
    """The sport whose list has the key; null where none has."""
    pairs = [F.lit(x) for sport, keys in table.items() for k in keys for x in (k, sport)]
    return F.element_at(F.create_map(*pairs), key)


def _known(sport: Column) -> Column:
    return F.nullif(sport, F.lit(UNKNOWN))


def by_title(title: Column, series: Column | None = None) -> Column:
    """By the title, else by the ticker of its series; `unknown` without a title."""
    found = first_match(title, TITLES)
    if series is not None:
        found = F.coalesce(found, first_match(series, SERIES))
    return F.when(F.coalesce(title, F.lit("")) == "", UNKNOWN).otherwise(F.coalesce(found, F.lit(UNKNOWN)))


def by_tags(tags: Column) -> Column:
    """By the first part, in the order of TAGS, that some tag holds: a later part of an earlier tag gives way."""
    low = F.concat(F.lit("\n"), F.array_join(F.transform(tags, F.lower), "\n"))
    out = F.lit(UNKNOWN)
    for part, sport in reversed(TAGS):
        out = F.when(F.contains(low, F.lit(part)), sport).otherwise(out)
    return bound(F.coalesce(out, F.lit(UNKNOWN)), lambda x: x)


def by_tag_id(tags: Column, tag_id: Column) -> Column:
    """By the id itself, else by tags that are numbers, the first that is known."""
    ids = F.concat(F.array(F.trim(tag_id.cast("string"))), F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.trim), lambda t: t.rlike(r"^\d+$")))
    sports = F.filter(F.transform(ids, lambda i: _looked_up(TAG_IDS, F.coalesce(i, F.lit("")))), lambda s: s.isNotNull())
    return F.coalesce(F.get(sports, 0), F.lit(UNKNOWN))


def by_reference(event_ref: Column, slug: Column, title: Column) -> Column:
    """By the first part of the event's reference, else soccer where reference, slug or title name one of its leagues."""
    ref = F.lower(F.coalesce(event_ref, F.lit("")))
    told = F.concat_ws("\n", ref, F.lower(F.coalesce(slug, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))))
    league = F.greatest(*(F.contains(told, F.lit(x)).cast("int") for x in LEAGUES)) == 1
    return F.coalesce(_looked_up(REFS, F.substring_index(ref, "-", 1)), F.when(league, "soccer"), F.lit(UNKNOWN))


def sport(tags: Column, title: Column, tag_id: Column, event_ref: Column, slug: Column) -> Column:
    """The sport of a listing of venue 2: by tag number, tags (as their aliases say), title, then references."""
    given = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    names = F.create_map(*(F.lit(x) for k, v in ALIASES.items() if v for x in (k, v)))
    silent = [k for k, v in ALIASES.items() if v is None]

    def from_tags(bits: Column) -> Column:
        low = F.transform(bits, F.lower)
        meant = F.transform(F.filter(low, lambda t: ~t.isin(*silent)), lambda t: F.coalesce(F.element_at(names, t), t))
        # Tags that all say nothing count for none; no tags at all find nothing either.
        return _known(by_tags(meant))

    return F.coalesce(_known(by_tag_id(given, tag_id)), bound(given, from_tags), _known(by_title(title)), by_reference(event_ref, slug, title))
