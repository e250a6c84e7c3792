"""Table profiles: key, columns, header aliases and grid column models.

A profile tells the generic operators (normalise, fold, filters) which column
is the key and which columns exist. The three shipment tables are defined here;
driver-table bindings in ``shipfold.plans`` build their own profiles.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableProfile:
    name: str
    key: str
    columns: tuple[str, ...]                  # data columns, key included
    aliases: dict[str, str] = field(default_factory=dict)  # normalised header -> column
    upsert_defaults: dict[str, str] = field(default_factory=dict)  # set when an upsert lacks them
    milestone: bool = False                   # status derived from atd/ata on each patch
    stamp_column: str | None = "last_updated"
    patch_columns: tuple[str, ...] | None = None  # fields a write-back may set (None: any)

    @property
    def value_columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c != self.key)


# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's interface): upload header aliases
# for the import-confirm table. Each column lists the normalised headers
# (lower-cased, stripped) that map to it, the column name itself included.
# ---------------------------------------------------------------------------
IMPORT_CONFIRM_ALIASES: dict[str, tuple[str, ...]] = {
    "status": ("status",),
    "tags": ("tags",),
    "op_remarks": ("op remarks", "op_remarks", "opremarks"),
    "abi_query_status": ("abi query status", "abi_query_status", "abistatus"),
    "abi_query_match": ("abi query match", "abi_query_match", "abimatch"),
    "uld_no": ("uld#", "uld no", "uld_no", "uld"),
    "hawb_customer": ("hawb customer / account code / cid / gid", "hawb customer",
                      "hawb_customer", "customer", "account code"),
    "mawb": ("m#", "mawb", "master awb", "master_awb"),
    "hawb": ("h#", "hawb", "house awb"),
    "eta": ("eta",),
    "pol": ("pol",),
    "pod": ("pod",),
    "airline": ("airline",),
    "firm_code": ("firm code", "firm_code", "firmcode"),
    "flight_no": ("flight no", "flight_no", "flightno", "flight"),
    "dest_handling_office": ("dest handling office", "dest_handling_office"),
    "dest_gateway_office": ("dest gateway office", "dest_gateway_office"),
    "address": ("address",),
    "last_free_date": ("last free date", "last_free_date", "lfd"),
    "wt": ("wt",),
    "sc_job_status": ("sc job status", "sc_job_status", "scjobstatus"),
    "sc_job_no": ("sc job no", "sc_job_no", "scjob"),
    "pre_alert_date": ("pre-alert date", "pre_alert_date", "prealertdate"),
    "dest_cs": ("dest cs", "dest_cs"),
    "is_ovs_agent": ("is ovs agent", "is_ovs_agent", "isovsagent"),
    "query_send_date": ("query send date", "query_send_date", "querysenddate"),
    "query_update_date": ("query update date", "query_update_date", "queryupdatedate"),
    "operator": ("operator",),
}

# FIXED VALUES: header labels of the scraped grid (lower-cased) -> column.
# Note the grid's own misspelt "dest handing office" label, which only this
# map knows.
SCRAPE_LABEL_ALIASES: dict[str, str] = {
    "status": "status",
    "abi query status": "abi_query_status",
    "abi query match": "abi_query_match",
    "tags": "tags",
    "uld#": "uld_no",
    "hawb customer / account code / cid / gid": "hawb_customer",
    "hawb customer": "hawb_customer",
    "m#": "mawb",
    "h#": "hawb",
    "eta": "eta",
    "pol": "pol",
    "pod": "pod",
    "airline": "airline",
    "firm code": "firm_code",
    "flight no": "flight_no",
    "dest handing office": "dest_handling_office",
    "dest handling office": "dest_handling_office",
    "dest gateway office": "dest_gateway_office",
    "address": "address",
    "last free date": "last_free_date",
    "wt": "wt",
    "sc job status": "sc_job_status",
    "op remarks": "op_remarks",
    "sc job no": "sc_job_no",
    "pre-alert date": "pre_alert_date",
    "dest cs": "dest_cs",
    "isovsagent": "is_ovs_agent",
    "query send date": "query_send_date",
    "query update date": "query_update_date",
    "operator": "operator",
}

# FIXED VALUES: pickup-report columns, in table order, and the aliases that do
# not follow the "underscores as spaces" rule.
PICKUP_COLUMNS: tuple[str, ...] = (
    "bl_no", "shipper", "equip_id", "lading_point", "owner", "final_dest",
    "pickup_scac", "tl_scac", "pou_actual", "cue_actual", "cur_actual",
    "tnf_actual", "cat_actual", "paa_actual", "doa_actual", "air_dwell",
    "shipment_status", "pud_actual", "total_cartons", "total_units", "notes",
)
PICKUP_EXTRA_ALIASES: dict[str, str] = {
    "b/l": "bl_no",
    "b/l no": "bl_no",
    "equipment id": "equip_id",
    "final destination": "final_dest",
}

# FIXED VALUES: import-confirm write-back columns (never in an upload).
IMPORT_CONFIRM_WRITEBACK: tuple[str, ...] = (
    "ata", "atd", "source_ata", "source_atd", "bot_eta", "bot_etd",
    "bot_status", "carrier_scrape", "cross_check_flag",
)

# FIXED VALUES: milestone table columns, in table order.
ATD_ATA_COLUMNS: tuple[str, ...] = (
    "mawb", "hawb", "customer", "airline", "flight", "status", "pol", "pod",
    "sla_date", "etd_orig", "eta", "atd", "ata",
)

# FIXED VALUES: milestone statuses, in the order the grid offers them.
MILESTONE_STATUSES: tuple[str, ...] = ("Pending Depart", "Pending Arrival", "Completed")

# FIXED VALUES: grid page sizes offered, default and maximum page size.
PAGE_SIZES: tuple[int, ...] = (50, 100, 200, 300, 500)
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500
TOP_K = 10

# FIXED VALUES: import-confirm grid column model: (column, grid label, filter
# kind, options key). Order is the grid's order after the selection column.
IMPORT_CONFIRM_GRID: tuple[tuple[str, str, str, str | None], ...] = (
    ("status", "Status", "select", "STATUS"),
    ("abi_query_status", "ABI Query Status", "select", "ABI_STATUS"),
    ("abi_query_match", "ABI Query Match", "select", "ABI_MATCH"),
    ("tags", "Tags", "select", "TAGS"),
    ("uld_no", "ULD#", "text", None),
    ("hawb_customer", "HAWB Customer / Account Code / CID / GID", "text", None),
    ("mawb", "M#", "text", None),
    ("hawb", "H#", "text", None),
    ("eta", "ETA", "daterange", None),
    ("pol", "POL", "text", None),
    ("pod", "POD", "text", None),
    ("airline", "Airline", "select", "AIRLINES"),
    ("firm_code", "Firm Code", "text", None),
    ("flight_no", "Flight No", "text", None),
    ("dest_handling_office", "Dest Handing Office", "select", "OFFICES"),
    ("dest_gateway_office", "Dest Gateway Office", "select", "OFFICES"),
    ("address", "Address", "text", None),
    ("last_free_date", "Last Free Date", "daterange", None),
    ("wt", "WT", "select", "WT"),
    ("sc_job_status", "SC Job Status", "select", "SC_JOB_STATUS"),
    ("op_remarks", "OP Remarks", "text", None),
    ("sc_job_no", "SC JOB No", "text", None),
    ("pre_alert_date", "Pre-Alert Date", "daterange", None),
    ("dest_cs", "Dest Cs", "select", "DEST_CS"),
    ("is_ovs_agent", "IsOvsAgent", "select", "IS_OVS_AGENT"),
    ("query_send_date", "Query Send Date", "daterange", None),
    ("query_update_date", "Query Update Date", "daterange", None),
    ("operator", "Operator", "text", None),
)

# FIXED VALUES: milestone grid column model.
ATD_ATA_GRID: tuple[tuple[str, str, str, str | None], ...] = (
    ("mawb", "M#", "text", None),
    ("hawb", "H#", "text", None),
    ("customer", "Customer", "text", None),
    ("airline", "Airline", "text", None),
    ("flight", "Flight No", "text", None),
    ("status", "Status", "select", "ATD_STATUS"),
    ("pol", "POL", "text", None),
    ("pod", "POD", "text", None),
    ("sla_date", "SLA Date", "daterange", None),
    ("etd_orig", "ETD (Original)", "daterange", None),
    ("eta", "ETA (Destination)", "daterange", None),
    ("atd", "ATD", "daterange", None),
    ("ata", "ATA", "daterange", None),
)

# FIXED VALUES: view defaults applied when a grid row comes from the table
# (null or blank -> default). Columns not listed default to ''.
IMPORT_CONFIRM_VIEW_DEFAULTS: dict[str, str] = {
    "status": "New",
    "abi_query_status": "New",
    "abi_query_match": "Not Existing",
}

# FIXED VALUES: the names that seed records and the grids use, and the columns they stand for.
IMPORT_CONFIRM_RECORD_KEYS: dict[str, str] = {
    "status": "status", "abiStatus": "abi_query_status", "abiMatch": "abi_query_match", "tags": "tags", "uld": "uld_no",
    "customer": "hawb_customer", "mno": "mawb", "hno": "hawb", "eta": "eta", "pol": "pol", "pod": "pod",
    "airline": "airline", "firm": "firm_code", "flight": "flight_no", "destHandling": "dest_handling_office",
    "destGateway": "dest_gateway_office", "addr": "address", "lfd": "last_free_date", "wt": "wt",
    "scStatus": "sc_job_status", "opRem": "op_remarks", "scJob": "sc_job_no", "preAlert": "pre_alert_date",
    "destCs": "dest_cs", "isOvs": "is_ovs_agent", "qSend": "query_send_date", "qUpdate": "query_update_date",
    "operator": "operator",
}
ATD_ATA_RECORD_KEYS: dict[str, str] = {
    "mawb": "mawb", "hawb": "hawb", "customer": "customer", "airline": "airline", "flight": "flight", "status": "status",
    "pol": "pol", "pod": "pod", "slaDate": "sla_date", "etdOrig": "etd_orig", "eta": "eta", "atd": "atd", "ata": "ata",
}

# FIXED VALUES: facet labels used when a status is null or blank.
STATUS_FACET_DEFAULT = "Unknown"
BOT_STATUS_FACET_DEFAULT = "pending"

# FIXED VALUES: update types of the milestone screen that map to a column;
# the others are refused.
UPDATE_TYPE_COLUMNS: dict[str, str | None] = {
    "Flight(Last Leg)": "flight_no",
    "ETA": "eta",
    "Terminal Location": None,
    "Warehouse": None,
}


# FIXED VALUES: fields a write-back payload may carry, per table; others
# are dropped from the payload.
IMPORT_CONFIRM_PATCH_FIELDS: tuple[str, ...] = (
    "eta", "flight_no", "airline", "status", "op_remarks", "ata", "atd", "source_ata",
    "source_atd", "bot_eta", "bot_etd", "bot_status", "carrier_scrape", "cross_check_flag",
)
ATD_ATA_PATCH_FIELDS: tuple[str, ...] = ("atd", "ata", "flight", "status")


def _alias_map(aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {a: col for col, names in aliases.items() for a in names}


def pickup_aliases() -> dict[str, str]:
    out: dict[str, str] = {}
    for col in PICKUP_COLUMNS:
        out[col.replace("_", " ")] = col
        out[col] = col
    out.update(PICKUP_EXTRA_ALIASES)
    return out


IMPORT_CONFIRM = TableProfile(
    name="import_confirm",
    key="mawb",
    columns=tuple(c for c, *_ in IMPORT_CONFIRM_GRID) + IMPORT_CONFIRM_WRITEBACK,
    aliases=_alias_map(IMPORT_CONFIRM_ALIASES),
    upsert_defaults={"bot_status": "pending"},
    patch_columns=IMPORT_CONFIRM_PATCH_FIELDS,
)

ATD_ATA = TableProfile(
    name="atd_ata",
    key="mawb",
    columns=ATD_ATA_COLUMNS,
    aliases={c: c for c in ATD_ATA_COLUMNS},
    milestone=True,
    patch_columns=ATD_ATA_PATCH_FIELDS,
)

PICKUP_REPORT = TableProfile(
    name="pickup_report",
    key="bl_no",
    columns=PICKUP_COLUMNS,
    aliases=pickup_aliases(),
    stamp_column=None,
)

PROFILES = {p.name: p for p in (IMPORT_CONFIRM, ATD_ATA, PICKUP_REPORT)}
