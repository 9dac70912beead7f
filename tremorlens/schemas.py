"""Declared schemas of the normalised tables.

Times stay ISO text where a source gives text; counts are DOUBLE or BIGINT and NULL
means "not stated".  Surrogate ids are not stored.
"""

from __future__ import annotations

TABLES = {
    "sources_log": "ts timestamp, url string, http_status int, sha256 string, bytes bigint, snapshot_path string, note string",
    "activations": "code string, snapshot_date date, name string, category string, sub_category string, event_time string, "
    "activation_time string, closed boolean, gdacs_id string, countries array<string>, centroid_wkt string, extent_wkt string",
    "activation_index": "code string, exists_public boolean, name string, category string, countries array<string>, "
    "event_time string, first_seen timestamp, last_checked timestamp",
    "products": "code string, aoi_name string, aoi_number int, ptype string, monitoring boolean, monitoring_number int, "
    "version_number int, status_code string, feasible boolean, expected_delivery string, delivery_time string, "
    "download_path string, snapshot_date date",
    "stats": "code string, aoi_name string, ptype string, monitoring_number int, version_number int, category string, "
    "subcategory string, unit string, total double, affected double, total_raw string, affected_raw string, snapshot_date date",
    "official_events": "source string, external_id string, fecha date, departamento string, municipio string, divipola string, "
    "evento string, muertos double, heridos double, desaparecidos double, personas double, familias double, "
    "viv_destruidas double, viv_averiadas double, lat double, lon double",
    "evidence": "aoi_name string, tipo string, url string, fuente string, fecha string, cita string, capturado_por string, "
    "snapshot_date date",
    "media_volume": "event_key string, fecha date, n_noticias_emm bigint, gdelt_vol double, n_fuentes bigint, n_chatmap bigint, "
    "snapshot_date date",
    "citizen_reports": "origen string, id_externo string, ts string, lat double, lon double, lat_pub double, lon_pub double, "
    "media_url string, media_local string, media_sha256 string, mensaje string, score int, "
    "checks struct<mmi:double,aoi:string,posterior_al_sismo:boolean,duplicado_de:string>, estado string, snapshot_date date",
    "news_items": "url string, feed_id string, fecha string, titulo string, medio string, medio_canonico string, "
    "medio_dominio string, snapshot_date date",
    "rud_daily": "snapshot_date date, departamento string, municipio string, familias bigint, personas bigint, "
    "viv_destruidas bigint, viv_averiadas bigint, habitables bigint, nohabitables bigint",
    "crosscheck": "aoi_name string, snapshot_date date, estado string, copernicus boolean, n_prensa bigint, n_oficial bigint, "
    "n_ciudadano bigint",
}
KEYS = {
    "activations": ["code", "snapshot_date"], "activation_index": ["code"],
    "products": ["code", "aoi_name", "ptype", "monitoring_number", "version_number", "snapshot_date"],
    "stats": ["code", "aoi_name", "ptype", "monitoring_number", "version_number", "category", "subcategory", "snapshot_date"],
    "official_events": ["source", "external_id"], "media_volume": ["event_key", "fecha", "snapshot_date"],
    "citizen_reports": ["origen", "id_externo"], "news_items": ["url"],
    "rud_daily": ["snapshot_date", "departamento", "municipio"], "crosscheck": ["aoi_name", "snapshot_date"],
    "sources_log": ["ts", "url", "http_status", "sha256", "bytes", "snapshot_path", "note"],
}
EVIDENCE_KINDS = ["oficial", "institucional", "prensa", "ciudadano"]
# Tables whose keys are history: a rewrite may add or correct rows, never lose one.
ACCUMULATING = ["rud_daily", "sources_log"]
