"""Report reading: evidence gate, source level, figures, cut-off date."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.dates import MONTHS_ES, iso_day, month_number
from tremorlens.functions.text import contains_any, fold, let, plain_spaces, strip_accents, strip_links

# Vocabulary of the event gate.
KEYWORDS = [
    "terremoto", "sismo", "temblor", "movimiento sismico", "edan", "rud", "damnific", "afectad",
    "vivienda", "herido", "fallecid", "san jose del palmar", "emergencia",
]
EVENT_TERMS = ["terremoto", "sismo", "temblor", "movimiento sismico"]
EVENT_PLACES = ["san jose del palmar", "choco"]
DAMAGE_TERMS = [
    "edan", "rud", "damnific", "afectad", "vivienda", "herido", "fallecid", "colaps", "averiad",
    "ayuda humanitaria", "calamidad", "emergencia",
]
GENERIC_PAGE_TERMS = [
    "consolidado anual de emergencias", "emergencias anuales", "mapa sitio", "zona privada",
    "biblioteca", "directorio", "normatividad", "inicio transparencia",
]
UNRELATED_TERMS = ["indonesia", "peru", "mexico", "chile", "japon", "rusia", "turquia"]
CONTEXT_TERMS = ["colombia", "ungrd", "sgc"]
IMPACTED_PLACES = [
    "Armenia", "Calarcá", "La Tebaida", "Montenegro", "Salento", "Zarzal", "Cartago", "Tuluá",
    "Buga", "Palmira", "Roldanillo", "Sevilla", "Caicedonia", "Jamundí", "Dagua", "Pereira",
    "Dosquebradas", "Dos Quebradas", "Santa Rosa de Cabal", "Manizales", "Villamaría", "Cali",
    "Buenaventura", "Quibdó", "Istmina", "San José del Palmar", "Quindío", "Valle del Cauca",
    "Risaralda", "Caldas", "Chocó",
]
EVENT_DATES = (
    r"10\s+de\s+agosto\s+de\s+2026|15\s+de\s+agosto\s+de\s+2026|agosto\s+de\s+2026"
    r"|2026-08|10-ago-2026|10/08/2026|15-08-2026|15/08/2026"
)

# Figures read from prose; group 1 is the number, first pattern that hits wins.
NUMBER = r"(\d{1,3}(?:[.,]\d{3})*|\d+)"
FIGURE_PATTERNS = {
    "departamentos_afectados": [
        rf"{NUMBER}\s+departamentos?\s+afectad",
        rf"departamentos?\s+afectad\w*\D{{0,30}}{NUMBER}",
    ],
    "municipios_afectados": [
        rf"{NUMBER}\s+municipios?\s+afectad",
        rf"municipios?\s+afectad\w*\D{{0,30}}{NUMBER}",
    ],
    "personas_afectadas": [
        rf"{NUMBER}\s+(?:personas|habitantes)\s+(?:afectad|damnificad)",
        rf"(?:personas|habitantes)\s+(?:afectad|damnificad)\w*\D{{0,40}}{NUMBER}",
        rf"{NUMBER}\s+(?:personas|habitantes)"
        r"(?!\s+(?:fallecid|muert|herid|desaparecid|rescatad|damnificad))(?:\W|$)",
    ],
    "familias_afectadas": [
        rf"{NUMBER}\s+familias?\s+(?:afectad|damnificad)?",
        rf"familias?\s+(?:afectad|damnificad)\w*\D{{0,40}}{NUMBER}",
    ],
    "viviendas_averiadas": [
        rf"{NUMBER}\s+viviendas?\s+(?:averiad|afectad)",
        rf"viviendas?\s+(?:averiad|afectad)\w*\D{{0,40}}{NUMBER}",
        rf"viviendas?[^.]{{0,80}}?{NUMBER}\s+(?:averiad|afectad)[oa]s?(?!\w)",
    ],
    "viviendas_destruidas": [
        rf"{NUMBER}\s+viviendas?\s+(?:destruid|colapsad)",
        rf"viviendas?\s+(?:destruid|colapsad)\w*\D{{0,40}}{NUMBER}",
        rf"viviendas?[^.]{{0,80}}?{NUMBER}\s+(?:destruid|colapsad)[oa]s?(?!\w)",
    ],
}
VICTIM_STEMS = {
    "heridos": "herid", "fallecidos": "(?:fallecid|muert)",
    "desaparecidos": "desaparecid", "rescatados": "rescatad",
}
FIGURES = [*FIGURE_PATTERNS, *VICTIM_STEMS]
# A noun without which no pattern of the metric can match.
FIGURE_NOUNS = {
    "departamentos_afectados": ["departamento"], "municipios_afectados": ["municipio"],
    "personas_afectadas": ["personas", "habitantes"], "familias_afectadas": ["familia"],
    "viviendas_averiadas": ["vivienda"], "viviendas_destruidas": ["vivienda"], "heridos": ["herid"],
    "fallecidos": ["fallecid", "muert"], "desaparecidos": ["desaparecid"], "rescatados": ["rescatad"],
}
# Fixed values: "left side can never be below right side".
FIGURE_RELATIONS = [
    ("personas_afectadas", "familias_afectadas"), ("personas_afectadas", "fallecidos"),
    ("personas_afectadas", "heridos"), ("personas_afectadas", "desaparecidos"),
]

# Words near a date that make it, or forbid it as, the cut-off of a report.
REPORT_WORDS = ["balance", "corte", "reporte", "consolidado", "actualiz", "cifras", "informe"]
EVENT_WORDS = ["sismo", "terremoto", "temblor", "magnitud", "epicentro"]

# Outlets and channels.
NATIONAL_OUTLETS = [
    "el tiempo", "eltiempo", "el espectador", "elespectador", "el colombiano", "elcolombiano",
    "caracol", "rcn", "semana", "la republica", "larepublica", "portafolio", "blu radio",
    "bluradio", "w radio", "wradio", "el heraldo", "elheraldo", "vanguardia", "pulzo",
    "la silla vacia", "lasillavacia", ".com.co", ".gov.co",
]
PRESS_HOSTS = (
    r"\b(eltiempo|elespectador|semana|larepublica|bluradio|rcnradio|caracol|wradio|infobae|france24"
    r"|elpais|qhubo|diariooccidente|cronicadelquindio|eldiario|latarde|choco7dias)\b"
)
AGENCY_CHANNELS = [
    "gestiondelriesgo.gov.co", "facebook.com/gestionungrd", "instagram.com/ungrd_oficial",
    "linkedin.com/company/ungrd",
]
INSTITUTION_CHANNELS = ["sgc.gov.co", "presidencia.gov", ".gov.co", "gov.co/"]
KNOWN_PUBLISHERS = {
    "eltiempo.com": "El Tiempo", "elespectador.com": "El Espectador", "semana.com": "Semana",
    "bluradio.com": "Blu Radio", "rcnradio.com": "RCN Radio", "caracol.com.co": "Caracol Radio",
    "wradio.com.co": "W Radio", "portal.gestiondelriesgo.gov.co": "UNGRD",
    "gestiondelriesgo.gov.co": "UNGRD", "sgc.gov.co": "Servicio Geológico Colombiano",
    "presidencia.gov.co": "Presidencia de Colombia",
}
CITED_SOURCES = [
    ("UNGRD", "Unidad Nacional para la Gestión del Riesgo de Desastres", "oficial_nacional",
     ["ungrd", "unidad nacional para la gestion del riesgo"]),
    ("SGC", "Servicio Geológico Colombiano", "oficial_nacional", ["servicio geologico colombiano"]),
    ("presidencia", "Presidencia de Colombia", "oficial_nacional",
     ["presidencia de la republica", "presidencia de colombia"]),
    ("gobernacion", "Gobernación citada en el texto", "oficial_departamental_por_verificar",
     ["gobernacion"]),
    ("alcaldia", "Alcaldía citada en el texto", "oficial_municipal_por_verificar", ["alcaldia"]),
]
SCORE_TERMS = [
    "fallecid", "muert", "herid", "desaparecid", "rescatad", "personas afectad", "familias afectad",
    "viviendas", "municipios afectad", "departamentos afectad", "balance", "reporte",
]
ISSUERS = [("unosat", "UNITAR-UNOSAT"), ("copernicus", "Copernicus EMS"), ("echo", "EC/ECHO")]
UNKNOWN_ISSUER = "Una fuente institucional"


@dataclass(frozen=True)
class EventProfile:
    """What makes a text evidence of one event; one profile per ``event_key``."""

    event_terms: list[str] = field(default_factory=lambda: EVENT_TERMS)
    event_places: list[str] = field(default_factory=lambda: EVENT_PLACES)
    damage_terms: list[str] = field(default_factory=lambda: DAMAGE_TERMS)
    generic_terms: list[str] = field(default_factory=lambda: GENERIC_PAGE_TERMS)
    unrelated_terms: list[str] = field(default_factory=lambda: UNRELATED_TERMS)
    context_terms: list[str] = field(default_factory=lambda: CONTEXT_TERMS)
    places: list[str] = field(default_factory=lambda: IMPACTED_PLACES)
    date_pattern: str = EVENT_DATES


DEFAULT_PROFILE = EventProfile()


def ascii_words(terms: list[str]) -> str:
    """Alternation between ASCII word boundaries, the web-side notion of a word."""
    body = "|".join(re.escape(t) for t in terms)
    return rf"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"


def _mentions_place(folded: Column, names: list[str]) -> Column:
    """Any name between word boundaries; texts that hold none skip the pattern."""
    import unicodedata

    plain = sorted({
        "".join(c for c in unicodedata.normalize("NFD", n) if unicodedata.category(c) != "Mn").lower() for n in names
    })
    return contains_any(folded, plain) & folded.rlike(ascii_words(plain))


def _signals(whole: Column, prose: Column, profile: EventProfile) -> dict[str, Column]:
    opening = F.substring(whole, 1, 500)
    place = _mentions_place(prose, profile.places)
    return {
        "generic": contains_any(whole, profile.generic_terms),
        "unrelated": contains_any(opening, profile.unrelated_terms)
        & ~contains_any(opening, profile.context_terms[:2]),
        "event": contains_any(prose, profile.event_terms) | _mentions_place(prose, profile.event_places),
        "context": contains_any(whole, profile.context_terms) | place,
        "damage": contains_any(whole, profile.damage_terms),
        "place": place,
        "date": whole.rlike(profile.date_pattern),
    }


def gate_signals(text: Column, profile: EventProfile = DEFAULT_PROFILE) -> Column:
    """The separate signals as a struct, so that each can be stored and audited.

    The two folded texts are computed once per row.
    """
    folded = F.struct(fold(text).alias("whole"), fold(strip_links(text)).alias("prose"))
    return let(folded, lambda t: F.struct(*[v.alias(k) for k, v in _signals(t["whole"], t["prose"], profile).items()]))


def is_event_evidence(text: Column, profile: EventProfile = DEFAULT_PROFILE) -> Column:
    """Specific evidence of the event."""

    def decide(t: Column) -> Column:
        s = _signals(t["whole"], t["prose"], profile)
        return ~s["generic"] & ~s["unrelated"] & s["event"] & s["context"] & (s["damage"] | s["place"] | s["date"])

    return let(F.struct(fold(text).alias("whole"), fold(strip_links(text)).alias("prose")), decide)


def is_candidate_link(text: Column, profile: EventProfile = DEFAULT_PROFILE) -> Column:
    """Worth following, before the page itself has been read."""
    return let(gate_signals(text, profile), lambda s: ~s["generic"] & s["event"] & (s["damage"] | s["place"] | s["date"]))


def _lower(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit("")))


def is_agency_channel(url: Column, text: Column) -> Column:
    low = _lower(url)
    video = contains_any(low, ["youtube.com", "youtu.be"]) & (
        fold(text).rlike(r"uploaded by.{0,80}(ungrd|unidad nacional para la gestion del riesgo)")
        | low.rlike(r"channel/[^)\s]+ungrd|@ungrd")
    )
    return contains_any(low, AGENCY_CHANNELS) | video


def source_level(url: Column, text: Column) -> Column:
    """P20: how official a page is, from its address and wording."""
    low = _lower(url)
    return (
        F.when(is_agency_channel(url, text), "oficial_comunicacion")
        .when(contains_any(low, INSTITUTION_CHANNELS), "oficial_institucional")
        .when(low.rlike(PRESS_HOSTS), "temporal_prensa")
        .otherwise("busqueda_web_temporal")
    )


def search_score(
    title: Column, description: Column, url: Column, profile: EventProfile = DEFAULT_PROFILE
) -> Column:
    """Relevance of a search hit as a sum of weighted signals."""
    from tremorlens.functions.text import LIVEBLOG_PHRASES

    empty = F.lit("")
    written = fold(F.concat_ws(" ", F.coalesce(title, empty), F.coalesce(description, empty), F.coalesce(url, empty)))

    def points(flag: Column, weight: int) -> Column:
        return F.when(flag, weight).otherwise(0)

    def total(t: Column) -> Column:
        text, prose = t["whole"], t["prose"]
        signals = _signals(text, prose, profile)
        official = is_agency_channel(url, text) | contains_any(_lower(url), INSTITUTION_CHANNELS)
        parts = [points(text.contains(term), 2) for term in SCORE_TERMS]
        parts += [
            points(text.rlike(r"\d"), 2), points(signals["context"], 3), points(official, 4),
            points(source_level(url, text) == "temporal_prensa", 1), points(signals["unrelated"], -20), points(text.rlike(LIVEBLOG_PHRASES), -6),
        ]
        return functools.reduce(operator.add, parts)

    folded = let(written, lambda w: F.struct(w.alias("whole"), fold(strip_links(w)).alias("prose")))
    return let(folded, total)


def cited_sources(text: Column) -> Column:
    """Official bodies named in the text, as an array of structs without repeats."""
    def named(folded: Column) -> Column:
        found = []
        for ident, name, kind, needles in CITED_SOURCES:
            hit = contains_any(folded, needles)
            if ident == "SGC":
                hit = hit | (folded.contains("sgc") & F.lower(text).rlike(ascii_words(["sgc"])))
            entry = F.struct(F.lit(ident).alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("type"))
            found.append(F.when(hit, entry))
        return F.filter(F.array(*found), lambda s: s.isNotNull())

    return let(fold(text), named)


def channel(url: Column) -> Column:
    """Where the page lives."""
    low = _lower(url)
    return (
        F.when(contains_any(low, ["youtube.com", "youtu.be"]), "youtube")
        .when(low.contains("facebook.com"), "facebook")
        .when(low.contains("instagram.com"), "instagram")
        .when(low.contains("linkedin.com"), "linkedin")
        .when(contains_any(low, ["x.com", "twitter.com"]), "x_twitter")
        .when(low.rlike(r"\.pdf($|\?)"), "pdf")
        .otherwise("web")
    )


def publisher_name(domain: Column, declared: Column | None = None) -> Column:
    """Declared name, else the known outlet of the domain, else the domain."""
    known = F.create_map(*[F.lit(v) for pair in KNOWN_PUBLISHERS.items() for v in pair])
    inferred = F.coalesce(F.try_element_at(known, domain), F.nullif(domain, F.lit("")))
    return inferred if declared is None else F.coalesce(F.nullif(declared, F.lit("")), inferred)


def is_national(name: Column, domain: Column, url: Column) -> Column:
    """National press by name, domain or address."""
    empty = F.lit("")
    text = fold(F.concat_ws(" ", *[F.coalesce(c, empty) for c in (name, domain, url)]))
    return contains_any(text, NATIONAL_OUTLETS)


def issuer(title: Column) -> Column:
    """Issuer of an institutional item from its title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    named = [F.when(low.contains(needle), name) for needle, name in ISSUERS]
    return F.coalesce(*named, F.lit(UNKNOWN_ISSUER))


def _victim_patterns(stem: str) -> list[str]:
    return [
        rf"{NUMBER}\s+personas?\s+{stem}[oa]s?(?!\w)",
        rf"{NUMBER}\s+{stem}[oa]s?(?!\w)",
        rf"{stem}[oa]s?\s*[:;\-–]\s*{NUMBER}",
    ]


def _figure(low: Column, metric: str) -> Column:
    """One figure: no pattern runs unless its noun occurs, later ones only after a miss."""
    patterns = FIGURE_PATTERNS.get(metric) or _victim_patterns(VICTIM_STEMS[metric])
    # a look-ahead lets the engine skip everything that is no digit at once
    quick = [(r"(?=\d)" + p if p.startswith(NUMBER) else p) for p in patterns]
    hits = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in quick]
    return F.when(contains_any(low, FIGURE_NOUNS[metric]), F.regexp_replace(F.coalesce(*hits), "[.,]", "").try_cast("bigint"))


def figures_of(texts: Column) -> Column:
    """P25: the ten figures of each text of an array.

    Two nested steps, so that the normalised text is computed once per text.
    """
    prepared = F.transform(texts, lambda t: F.lower(plain_spaces(t)))
    return F.transform(prepared, lambda low: F.struct(*[_figure(low, m).alias(m) for m in FIGURES]))


def figures(text: Column) -> Column:
    """P25: the ten figures of one text as a struct."""
    return figures_of(F.array(text))[0]


def broken_relations(values: Column) -> Column:
    """Impossible relations among the figures of one report."""
    checks = [
        F.when(values[a] < values[b], F.lit(f"{a} < {b}")) for a, b in FIGURE_RELATIONS
    ]
    return F.filter(F.array(*checks), lambda r: r.isNotNull())


def read_figures(df: DataFrame, text: str, out: str = "figures") -> DataFrame:
    """P25 + P26: figures of the link-free text, one retry on the raw text, culprits dropped.

    Adds ``out`` (struct), ``attempts`` (array of structs) and ``discarded``.
    """
    attempt = "struct<attempt:int,input:string,broken:array<string>>"
    # one lambda reads both inputs, so the long rule list is planned once; a text without
    # links would only repeat the first reading and is not read again
    clean = strip_links(F.col(text))
    inputs = F.array(clean, F.when(F.col(text) != clean, F.col(text)))
    read = df.withColumn("_in", inputs).withColumn("_f", figures_of(F.col("_in")))
    first = read.withColumn("_f1", F.col("_f")[0]).withColumn("_b1", broken_relations(F.col("_f")[0]))
    again = F.when(F.col("_in")[1].isNull(), F.col("_f")[0]).otherwise(F.col("_f")[1])
    retry = first.withColumn("_f2", F.when(F.size("_b1") > 0, again)).withColumn(
        "_b2", F.when(F.size("_b1") > 0, broken_relations(F.col("_f2")))
    )
    failed = F.coalesce(F.size("_b2") > 0, F.lit(False))
    culprits = F.array_distinct(
        F.transform(F.concat(F.col("_b1"), F.col("_b2")), lambda r: F.split(r, " < ")[0])
    )
    kept = F.struct(
        *[F.when(~F.array_contains(culprits, m), F.col("_f1")[m]).alias(m) for m in FIGURES]
    )
    log1 = F.struct(F.lit(1).alias("attempt"), F.lit("link_free_text").alias("input"), F.col("_b1").alias("broken"))
    log2 = F.struct(F.lit(2).alias("attempt"), F.lit("raw_text").alias("input"), F.col("_b2").alias("broken"))
    return (
        retry.withColumn(
            out,
            F.when(F.size("_b1") == 0, F.col("_f1")).when(~failed, F.col("_f2")).otherwise(kept),
        )
        .withColumn(
            "attempts",
            F.when(F.size("_b1") == 0, F.array(log1)).otherwise(F.array(log1, log2)).cast(f"array<{attempt}>"),
        )
        .withColumn("discarded", F.when(failed, culprits))
        .drop("_in", "_f", "_f1", "_b1", "_f2", "_b2")
    )


def _cutoff_pattern() -> str:
    """A day-month date that a report word governs and no event word precedes.

    Bounded look-around keeps the whole rule inside one JVM regular expression; the
    look-ahead in front makes sure the costly part runs at dates only.
    """
    months = "|".join(MONTHS_ES)
    date = rf"\d{{1,2}}\s+de\s+(?:{months})(?:\s+de\s+20\d{{2}})?(?![A-Za-z0-9_])"
    gate = rf"(?=\d{{1,2}}\s+de\s+(?:{months}))(?<![A-Za-z0-9_])"
    no_event = "".join(rf"(?<!{w}[^.]{{0,24}})" for w in EVENT_WORDS)
    before = "|".join(rf"(?<={w}[\s\S]{{0,{70 - len(w)}}})" for w in REPORT_WORDS)
    after = "|".join(rf"(?=[\s\S]{{0,{45 - len(w)}}}{w})" for w in REPORT_WORDS)
    return f"(?i){gate}{no_event}(?:(?:{before}){date}|{date}(?:{after}))"


def cutoff_day(text: Column, default_year: str) -> Column:
    """Day the report speaks of, as ISO text; NULL when the text does not say."""
    def written(words: Column) -> Column:
        month = month_number(F.get(words, F.lit(2)), MONTHS_ES)
        return F.when(month.isNotNull(), iso_day(F.coalesce(F.get(words, F.lit(4)), F.lit(default_year)), month, F.get(words, F.lit(0))))

    hit = F.regexp_extract(plain_spaces(text), _cutoff_pattern(), 0)
    return let(F.split(F.lower(hit), r"\s+"), written)


def prose_day(text: Column) -> Column:
    """P10: first ``d de <month> de 20yy`` in the prose."""
    shape = (
        r"(?i)(?<![A-Za-z0-9_])(\d{1,2})\s+de\s+([a-záéíóú]+)\s+de\s+(20\d{2})(?![A-Za-z0-9_])"
    )
    clean = plain_spaces(text)
    part = [F.regexp_extract(clean, shape, i) for i in (1, 2, 3)]
    month = month_number(F.lower(strip_accents(part[1])), MONTHS_ES)
    return F.when(month.isNotNull(), iso_day(part[2], month, part[0]))


def dated_cutoff(declared: Column, url: Column, stated: Column) -> Column:
    """struct(day, signal): the text's own date, else the address, else the field."""
    shape = r"/(20\d\d)/(\d\d)/(\d\d)/"
    from_url = F.when(
        url.rlike(shape), iso_day(*[F.regexp_extract(url, shape, i) for i in (1, 2, 3)])
    )
    declared, stated = F.nullif(declared, F.lit("")), F.nullif(stated, F.lit(""))

    def tagged(day: Column, signal: str) -> Column:
        return F.when(day.isNotNull(), F.struct(day.alias("day"), F.lit(signal).alias("signal")))

    return F.coalesce(tagged(declared, "text"), tagged(from_url, "url"), tagged(stated, "field"))


def report_lag_days(published: Column, cutoff: Column) -> Column:
    """Days from cut-off to publication; negative or unknown is NULL."""
    days = F.datediff(
        F.try_to_date(F.substring(published, 1, 10)), F.try_to_date(F.substring(cutoff, 1, 10))
    )
    return F.when(days >= 0, days)


def report_status(text: Column) -> Column:
    """What kind of report the wording suggests."""
    return let(
        fold(text),
        lambda folded: F.when(contains_any(folded, ["edan", "rud", "damnific"]), "oficial_posible_edan_rud")
        .when(contains_any(folded, ["vivienda", "afectad", "herido", "fallecid"]), "oficial_con_posibles_cifras")
        .when(contains_any(folded, ["sismo", "terremoto", "temblor"]), "oficial_menciona_evento")
        .otherwise("oficial_no_relacionado"),
    )


def report_confidence(text: Column, profile: EventProfile = DEFAULT_PROFILE) -> Column:
    """How much an automatic reading of this text deserves."""
    evidence = is_event_evidence(text, profile)
    figures_named = text.rlike(r"(?i)edan|rud|damnific|viviendas?|heridos?|fallecid")
    return (
        F.when(evidence & figures_named & text.rlike(r"[0-9]"), "media")
        .when(evidence, "baja")
        .otherwise("ninguna")
    )


def report_quote(text: Column, keywords: list[str] | None = None) -> Column:
    """First sentence that speaks of the event, at most 280 characters."""
    words = keywords or KEYWORDS
    sentences = F.split(text, r"(?<=[.!?])\s+")
    first = F.try_element_at(F.filter(sentences, lambda s: contains_any(fold(s), words)), F.lit(1))
    return F.substring(F.coalesce(first, F.substring(text, 1, 240)), 1, 280)


def stamp_rules(df: DataFrame, **versions: str) -> DataFrame:
    """Which rule produced each row, so old and new readings stay apart."""
    return df.withColumns({name: F.lit(value) for name, value in versions.items()})
