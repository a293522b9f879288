"""Business error codes carried by reject rows."""

# Code -> (meaning, numeric code).
ERROR_CODES: dict[str, tuple[str, int]] = {
    "M1001": ("item not found", -20101),
    "M1002": ("item inactive", -20102),
    "M1003": ("category not found", -20103),
    "M1004": ("duplicate item", -20104),
    "M1101": ("unit of measure not found", -20111),
    "M1102": ("units of measure incompatible", -20112),
    "M2001": ("bill of materials not found", -20201),
    "M2002": ("bill of materials cycle", -20202),
    "M2003": ("no active bill of materials", -20203),
    "M2004": ("invalid bill of materials line", -20204),
    "M3001": ("stock insufficient", -20301),
    "M3002": ("lot not found", -20302),
    "M3003": ("lot expired", -20303),
    "M3004": ("balance not found", -20304),
    "M3005": ("quantity not allowed", -20305),
    "M4001": ("purchase order not found", -20401),
    "M4002": ("purchase order state invalid", -20402),
    "M4003": ("over-receipt", -20403),
    "M4004": ("supplier blocked", -20404),
    "M5001": ("planning run still running", -20501),
    "M5002": ("planning run not found", -20502),
    "M5003": ("production order not found", -20503),
    "M6001": ("price rule missing", -20601),
    "M6002": ("price list not found", -20602),
}
UNKNOWN_NUMERIC_CODE = -20999
