"""Row predicates, code handling and derived bar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorframe.functions import rolling as R

# Board prefixes and the daily price-limit threshold of each board.
BOARD_PREFIXES = {"star": ("sh688", "sh689"), "chinext": ("sz300", "sz301"), "bj": ("bj",)}
BOARD_LIMITS = {"main": 0.099, "chinext": 0.199, "star": 0.199, "bj": 0.299}

# Leading digits of plain codes per exchange, and of the Beijing board.
EXCHANGE_HEADS = {
    "sh": ("60", "68", "90", "11", "13"),
    "sz": ("00", "30", "12", "15"),
    "bj": ("83", "87", "43", "92", "88"),
}
DEFAULT_EXCHANGE = "sh"
BEIJING_HEADS = ("8", "4", "920", "83", "87", "43")


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def derived_amount(amount: str | Column | None = "amount") -> Column:
    product = F.col("volume") * F.col("close")
    return product if amount is None else F.coalesce(_col(amount), product)


def derived_pct_chg() -> Column:
    return 100 * R.pct_change("close", 1)


def derived_preclose() -> Column:
    return R.ref("close", 1)


def is_st(name: str | Column = "name") -> Column:
    """Special-treatment flag from the name; unknown name gives unknown flag."""
    return F.contains(_col(name), F.lit("ST"))


def is_suspended(volume: str | Column = "volume", amount: str | Column | None = "amount") -> Column:
    no_volume = F.coalesce(_col(volume), F.lit(0.0)) == 0
    return no_volume if amount is None else no_volume & (F.coalesce(_col(amount), F.lit(0.0)) == 0)


def is_one_price(suspended: str | Column = "is_suspended") -> Column:
    """Locked at one price while trading."""
    same = (F.col("high") == F.col("low")) & (F.col("high") == F.col("close"))
    return same & ~F.coalesce(_col(suspended), F.lit(False))


def board_class(code: str | Column = "code") -> Column:
    lowered = F.lower(_col(code))
    out = F.lit("main")
    for board, prefixes in BOARD_PREFIXES.items():
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | lowered.startswith(prefix)
        out = F.when(hit, board).otherwise(out)
    return out


def board_threshold(board: str | Column) -> Column:
    board = _col(board)
    out = F.lit(BOARD_LIMITS["main"])
    for name, limit in BOARD_LIMITS.items():
        out = F.when(board == name, limit).otherwise(out)
    return out


def limit_buy(change: str | Column, close: str | Column, board: str | Column) -> Column:
    """A buy cannot fill: limit up, or no price."""
    return F.coalesce(_col(change) >= board_threshold(board), F.lit(False)) | _col(close).isNull()


def limit_sell(change: str | Column, close: str | Column, board: str | Column) -> Column:
    return F.coalesce(_col(change) <= -board_threshold(board), F.lit(False)) | _col(close).isNull()


def plain_code(code: str | Column = "code") -> Column:
    """Six digits without an exchange prefix or suffix."""
    text = F.lower(F.trim(_col(code).cast("string")))
    return F.lpad(F.regexp_replace(text, r"^(sh|sz|bj)\.?", ""), 6, "0")


def exchange_of(code: str | Column = "code") -> Column:
    plain = plain_code(code)
    out = F.lit(DEFAULT_EXCHANGE)
    for exchange, heads in EXCHANGE_HEADS.items():
        out = F.when(plain.substr(1, 2).isin(*heads), exchange).otherwise(out)
    return out


def prefixed_code(code: str | Column = "code") -> Column:
    """Exchange prefix, from the leading digits, before the plain code."""
    return F.concat(exchange_of(code), plain_code(code))


def is_beijing(code: str | Column = "code") -> Column:
    plain = plain_code(code)
    hit = F.lit(False)
    for head in BEIJING_HEADS:
        hit = hit | plain.startswith(head)
    return hit
