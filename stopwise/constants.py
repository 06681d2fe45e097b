"""Fixed values of the delivery domain: they decide results, so they are stated once, here."""

# Operation codes of the three delivery programmes (fixed values).
CAPITAL_OPS = (38, 39, 100, 1171, 101, 172, 112, 130, 113)
INTERIOR_WEEK_OPS = (45, 46, 104, 105, 110, 111, 114, 115)
INTERIOR_GENERAL_OPS = (45, 46, 49, 50, 61, 104, 105, 114, 115)

# Delivery statuses that are routed (fixed values).
ROUTED_STATUSES = (1, 3)
ACTIVE = 1
IS_CLIENT = 1

# Depots as (latitude, longitude) in degrees (fixed values).
CITY_DEPOT = (-3.7572635, -38.5854081)
INTERIOR_DEPOT = (-3.8121165, -39.2586648)
EARTH_RADIUS_KM = 6371.0

# Area labels left out of the customer master (fixed values).
EXCLUDED_AREAS = (
    "999 - L80-INDUSTRIA",
    "700 - L81 - REMESSA VENDA",
    "142 - L82-PARACURU-LICITAÇÃO",
    "147 - L82-PARAIPABA-LICITAÇÃO",
    "149 - L82-SGA-LICITAÇÃO",
    "000 - L82-EXTRA ROTA",
)

# Region codes looked for in the area text, first match wins, and their labels (fixed values).
REGION_LABELS = (("L81", "L81-CAPITAL"), ("L82", "L82-INTERIOR"))
OTHER_REGION = "OUTROS"

# Texts shown where a value is missing (fixed values).
NO_ROSTER_DRIVER = "SEM ROTA DEFINIDA"
UNKNOWN_DRIVER = "DESCONHECIDO"
NO_SUPERVISOR = "N/A"
MISSING_TEXT = "-"

# Visit priorities: default and labels (fixed values).
DEFAULT_PRIORITY = 3
PRIORITY_LABELS = {1: "☀️ MANHÃ", 2: "⚡ ATÉ 16h"}
DAYTIME_LABEL = "🕒 DIURNO"

# Colours of routes, taken in turn, and the colours of what has none (fixed values).
ROUTE_COLORS = ("red", "blue", "green", "purple", "orange", "darkred", "darkblue", "cadetblue", "pink", "black")
NO_ROUTE_COLOR = "gray"
NO_MARKER_COLOR = "#999"
PALETTE_SATURATION, PALETTE_VALUE = 0.75, 0.90
HASH_SATURATION, HASH_VALUE = 0.65, 0.95
