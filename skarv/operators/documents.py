"""Registry documents in JSON brought to flat, typed rows; what a document lacks is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = "struct<adresse: array<string>, postnummer: string, poststed: string, kommune: string, kommunenummer: string, land: string>"
ENTITY = f"""organisasjonsnummer string, navn string, organisasjonsform struct<kode: string>, naeringskode1 struct<kode: string, beskrivelse: string>, antallAnsatte long, hjemmeside string, epostadresse string, telefon string, mobil string,
 registreringsdatoEnhetsregisteret string, stiftelsesdato string, konkurs boolean, underAvvikling boolean, sisteInnsendteAarsregnskap string, forretningsadresse {ADDRESS}, postadresse {ADDRESS}, vedtektsfestetFormaal array<string>, aktivitet array<string>"""
ACCOUNT = """id: long, valuta: string, regnskapstype: string, regnskapsperiode: struct<fraDato: string, tilDato: string>, resultatregnskapResultat: struct<aarsresultat: double, ordinaertResultatFoerSkattekostnad: double, driftsresultat: struct<driftsresultat: double, driftsinntekter: struct<sumDriftsinntekter: double>>>,
 eiendeler: struct<sumEiendeler: double>, egenkapitalGjeld: struct<egenkapital: struct<sumEgenkapital: double>, gjeldOversikt: struct<sumGjeld: double>>"""
ROLES = "rollegrupper array<struct<type: struct<kode: string>, sistEndret: string, roller: array<struct<type: struct<kode: string>, fratraadt: boolean, person: struct<navn: struct<fornavn: string, mellomnavn: string, etternavn: string>>, enhet: struct<organisasjonsnummer: string, navn: array<string>>>>>>"
UNITS = f"_embedded struct<underenheter: array<struct<organisasjonsnummer: string, navn: string, antallAnsatte: long, beliggenhetsadresse: {ADDRESS}, postadresse: {ADDRESS}>>>"


def address(column: Column) -> Column:
    """An address without its empty parts; null if nothing is left."""
    line = F.array_join(F.filter(column["adresse"], lambda x: x != ""), ", ")
    parts = {"line": F.nullif(line, F.lit("")), **{name: F.nullif(column[name], F.lit("")) for name in ("postnummer", "poststed", "kommune", "kommunenummer", "land")}}
    return F.when(F.coalesce(*parts.values()).isNotNull(), F.struct(*(v.alias(k) for k, v in parts.items())))


def entities(rows: DataFrame, key: str, body: str) -> DataFrame:
    """One row an entity document."""
    e = F.from_json(body, ENTITY)
    made = rows.select(key, e.alias("_e"))
    return made.select(
        key, F.col("_e.organisasjonsnummer").alias("organisation_number"), F.col("_e.navn").alias("name"), F.col("_e.organisasjonsform.kode").alias("legal_form"), F.col("_e.naeringskode1.kode").alias("industry"), F.col("_e.naeringskode1.beskrivelse").alias("industry_name"),
        F.col("_e.antallAnsatte").alias("employees"), F.col("_e.hjemmeside").alias("website"), F.col("_e.epostadresse").alias("email"), F.coalesce("_e.telefon", "_e.mobil").alias("phone"), F.col("_e.registreringsdatoEnhetsregisteret").try_cast("date").alias("registered"),
        F.col("_e.stiftelsesdato").try_cast("date").alias("founded"), F.col("_e.konkurs").alias("bankrupt"), F.col("_e.underAvvikling").alias("winding_up"), F.col("_e.sisteInnsendteAarsregnskap").alias("latest_accounts"),
        address(F.col("_e.forretningsadresse")).alias("business_address"), address(F.col("_e.postadresse")).alias("postal_address"),
        F.nullif(F.concat_ws(" ", "_e.vedtektsfestetFormaal"), F.lit("")).alias("purpose"), F.nullif(F.concat_ws(" ", "_e.aktivitet"), F.lit("")).alias("activity"),
    )


def accounts(rows: DataFrame, key: str, body: str, most: int = 3) -> DataFrame:
    """One row each of the first ``most`` accounts of a list document, in its order from 1."""
    a = F.slice(F.from_json(body, f"array<struct<{ACCOUNT}>>"), 1, most)
    made = rows.select(key, F.posexplode(a).alias("_at", "_a"))
    return made.select(
        key, (F.col("_at") + 1).alias("position"), F.col("_a.regnskapsperiode.fraDato").alias("period_from"), F.col("_a.regnskapsperiode.tilDato").alias("period_to"), F.col("_a.valuta").alias("currency"), F.col("_a.regnskapstype").alias("kind"),
        F.col("_a.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter").alias("revenue"), F.col("_a.resultatregnskapResultat.driftsresultat.driftsresultat").alias("operating_result"),
        F.col("_a.resultatregnskapResultat.ordinaertResultatFoerSkattekostnad").alias("profit_before_tax"), F.col("_a.resultatregnskapResultat.aarsresultat").alias("net_result"),
        F.col("_a.eiendeler.sumEiendeler").alias("total_assets"), F.col("_a.egenkapitalGjeld.egenkapital.sumEgenkapital").alias("equity"), F.col("_a.egenkapitalGjeld.gjeldOversikt.sumGjeld").alias("total_debt"),
    )


def in_period(start: Column, end: Column, year: Column) -> Column:
    """Whether a period is one and begins or ends in the year; null without a year."""
    return F.when(year.isNotNull(), F.coalesce((start <= end) & ((F.substring(start, 1, 4) == year) | (F.substring(end, 1, 4) == year)), F.lit(False)))


def roles(rows: DataFrame, key: str, body: str) -> DataFrame:
    """One row a holder of a role, persons by the parts of their name that there are, firms by theirs."""
    groups = rows.select(key, F.explode(F.from_json(body, ROLES)["rollegrupper"]).alias("_g"))
    made = groups.select(key, F.col("_g.sistEndret").alias("last_changed"), F.explode("_g.roller").alias("_r"))
    person = F.nullif(F.concat_ws(" ", F.nullif(F.col("_r.person.navn.fornavn"), F.lit("")), F.nullif(F.col("_r.person.navn.mellomnavn"), F.lit("")), F.nullif(F.col("_r.person.navn.etternavn"), F.lit(""))), F.lit(""))
    return made.select(key, F.col("_r.type.kode").alias("role"), F.coalesce(person, F.nullif(F.concat_ws(" ", "_r.enhet.navn"), F.lit(""))).alias("holder"), F.col("_r.enhet.organisasjonsnummer").alias("holder_number"), F.coalesce("_r.fratraadt", F.lit(False)).alias("left_office"), "last_changed")


def locations(rows: DataFrame, key: str, body: str) -> DataFrame:
    """One row a subunit, at its location or else its postal address."""
    made = rows.select(key, F.explode(F.from_json(body, UNITS)["_embedded"]["underenheter"]).alias("_u"))
    return made.select(key, F.col("_u.organisasjonsnummer").alias("unit_number"), F.col("_u.navn").alias("name"), F.col("_u.antallAnsatte").alias("employees"), F.coalesce(address(F.col("_u.beliggenhetsadresse")), address(F.col("_u.postadresse"))).alias("address"))


def with_reasons(rows: DataFrame, rules: dict[str, Column], name: str = "reasons") -> DataFrame:
    """``rows`` with the names of the rules they break, in order; a rule that can't be told is broken."""
    return rows.withColumn(name, F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(reason)) for reason, rule in rules.items()))))


def updates(rows: DataFrame, document: str, kind: str = "enheter") -> DataFrame:
    """``update_id, date, organisation_number, change_type, changed_fields`` of a feed's documents; the changed fields sorted, each once.

    Changes are a list of members that name a ``path``, ``felt`` or ``field``,
    or one object whose keys they are.
    """
    listed = {"enheter": "oppdaterteEnheter"}.get(kind, "oppdaterteUnderenheter")
    entry = "struct<oppdateringsid:string,dato:string,organisasjonsnummer:string,endringstype:string,endringer:string>"
    read = rows.select(F.inline(F.from_json(document, f"struct<_embedded:struct<{listed}:array<{entry}>>>")["_embedded"][listed]))
    members = F.from_json("endringer", "array<struct<path:string,felt:string,field:string>>")
    paths = F.when(F.startswith("endringer", F.lit("[")), F.transform(members, lambda m: F.coalesce(F.nullif(m["path"], F.lit("")), F.nullif(m["felt"], F.lit("")), m["field"]))).otherwise(F.json_object_keys("endringer"))
    return read.select(F.col("oppdateringsid").alias("update_id"), F.col("dato").alias("date"), F.coalesce("organisasjonsnummer", F.lit("")).alias("organisation_number"), F.col("endringstype").alias("change_type"), F.array_sort(F.array_distinct(F.array_compact(F.coalesce(paths, F.array().cast("array<string>"))))).alias("changed_fields"))


def contact_fields(columns: dict[str, str]):
    """A map of the contact fields that are given."""
    made = F.create_map(*(x for name, column in columns.items() for x in (F.lit(name), F.col(column).cast("string"))))
    return F.map_filter(made, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
