"""Source rows to canonical rows: mapping, validation with a quarantine, image links, ids."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

#: Columns that may hold the image link, in order.
IMAGE_COLUMNS = ("payment_documents", "payment_document", "payment_proof", "payment_receipt", "document_url", "image_url", "image", "document")
_URL, _IMAGE = r"https?://[^\s\"'\\\]}<>]+", r"(?i)\.(jpe?g|png|webp|gif|bmp|tiff?|heic|heif)(\?|#|$)"


@dataclass
class Mapping:
    """Canonical field to source column, with what makes a row valid. Keys that begin with ``_`` are comments."""

    fields: dict[str, str]
    created_at: str = "created_at"
    lead_id: str = "id"
    prefix: str = "LEAD-"
    required: list[str] = field(default_factory=list)
    check_amount: bool = True
    check_date: bool = True
    passthrough: bool = True

    @classmethod
    def from_config(cls, cfg: dict) -> Mapping:
        plain = lambda d: {k: v for k, v in (d or {}).items() if not k.startswith("_")}
        cursor, lead, check = plain(cfg.get("cursor")), plain(cfg.get("lead_id")), plain(cfg.get("validate"))
        return cls(
            plain(cfg.get("fields")), cursor.get("created_at_column", "created_at"), lead.get("column", cursor.get("id_column", "id")),
            lead.get("prefix", ""), list(cfg.get("required", [])), check.get("amount_numeric", True), check.get("date_parseable", True),
            cfg.get("extra_columns_passthrough", True),
        )


def map_rows(raw: DataFrame, m: Mapping, fuzzy_dates: bool = True) -> DataFrame:
    """Canonical columns, unmapped columns, ``lead_id`` and ``reason``: null for valid rows, else the first failed check."""
    canon = {c: s for c, s in m.fields.items() if c != "image"}
    col = lambda s: F.col(f"`{s}`") if s in raw.columns else F.lit(None).cast("string")
    out = {c: col(s) for c, s in canon.items()}
    if m.fields.get("image"):
        out["payment_document"] = col(m.fields["image"])
    if m.passthrough:
        out |= {c: F.col(f"`{c}`") for c in raw.columns if c not in m.fields.values() and c not in out}
    own = text.strip(col(m.lead_id))
    lead = F.when(own != "", F.concat(F.lit(m.prefix), own))
    bad = lambda c, why, test: F.when(text.present(c) & ~test, F.concat(F.lit(f"{why}: '"), c.cast("string"), F.lit("'")))
    checks = [F.when(lead.isNull(), f"missing lead id (column '{m.lead_id}')"), F.when(col(m.created_at).isNull(), f"missing cursor timestamp (column '{m.created_at}')")]
    checks += [F.when(~text.present(out.get(f, F.lit(None).cast("string"))), f"missing required field '{f}'") for f in m.required]
    if m.check_amount and "payment_amount" in out:
        checks.append(bad(out["payment_amount"], "payment_amount not numeric", text.is_number(out["payment_amount"])))
    if m.check_date and "payment_date" in out:
        parsed = dates.parse_date(out["payment_date"], fuzzy_dates, iso_day_first=False).isNotNull()
        checks.append(bad(out["payment_date"], "payment_date not parseable", parsed))
    out.pop("lead_id", None)
    return raw.select(lead.alias("lead_id"), *(c.alias(n) for n, c in out.items()), F.coalesce(*checks).alias("reason"))


def clean_source(cell: Column) -> Column:
    """The first link of a cell, also inside a JSON list; else the list's first filled entry, else the cell."""
    s = text.strip(cell)
    url = F.regexp_replace(F.regexp_extract(s, _URL, 0), "[.,;]+$", "")
    inner = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), 0), s)
    listed = F.from_json(F.when(s.startswith('"'), inner).otherwise(s), "array<string>")
    first = text.strip(F.get(F.filter(listed, lambda x: text.strip(x) != ""), 0))
    bare = F.when(s.startswith('"'), text.strip(inner)).otherwise(F.regexp_replace(s, r'^[\[\]"\\ ]+|[\[\]"\\ ]+$', ""))
    return F.when(url != "", url).when(s.rlike(r'^[\["]'), F.when(listed.isNotNull(), first).otherwise(bare)).otherwise(s)


def looks_like_image(link: Column) -> Column:
    return F.lower(link).startswith("data:image/") | link.rlike(_IMAGE)


def resolve_image(df: DataFrame, column: str = "payment_document", root: str = "") -> Column:
    """Where a row's image is: the chosen column, the usual ones in order, then any image link, then a sole link."""
    named = [c for c in dict.fromkeys([column, *IMAGE_COLUMNS]) if c in df.columns]
    rest = [clean_source(F.col(f"`{c}`")) for c in df.columns if c not in named]
    links = F.filter(F.array(*rest) if rest else F.array().cast("array<string>"), lambda x: F.lower(x).rlike("^(http|data:)"))
    any_image = F.get(F.filter(links, looks_like_image), 0)
    found = F.coalesce(*(F.nullif(clean_source(F.col(f"`{c}`")), F.lit("")) for c in named), any_image, F.when(F.size(links) == 1, F.get(links, 0)), F.lit(""))
    if not root:
        return found
    local = (found != "") & ~found.startswith("/") & ~F.lower(found).startswith("http")
    return F.when(local, F.concat(F.lit(root.rstrip("/") + "/"), found)).otherwise(found)


def with_lead_id(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Add ``lead_id``: the chosen column trimmed, or an id from the row's content."""
    chosen = F.nullif(text.strip(F.col(id_col)), F.lit("")) if id_col else F.lit(None).cast("string")
    return df.withColumn("lead_id", F.coalesce(chosen, text.content_id([c for c in df.columns if c != "lead_id"])))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def multi_select(df: DataFrame, chosen: dict[str, list[str] | None]) -> DataFrame:
    """Rows whose columns hold one of the chosen values, blanks shown as a dash; None chooses all."""
    return df.where(all_of([F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—")).isin(*v) for c, v in chosen.items() if v is not None]))
