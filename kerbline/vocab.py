"""Fixed values the results depend on: vocabularies, thresholds, lookup tables."""

# --- fixed values -----------------------------------------------------------
SURFACE_TYPES = ["asphalt", "concrete", "paving_stones", "sett", "gravel", "mud", "unpaved"]
SURFACE_LOOKUP = {
    "asphalt": "asphalt",
    "concrete": "concrete",
    "paving stones": "paving_stones",
    "paving_stones": "paving_stones",
    "sett": "sett",
    "gravel": "gravel",
    "mud": "mud",
    "unpaved": "unpaved",
}
QUALITY_WORDS = {"excellent": 1, "good": 2, "intermediate": 3, "bad": 4, "very bad": 5, "very_bad": 5, "verybad": 5}
QUALITY_GRADES = [1, 2, 3, 4, 5]

DEFECT_LABELS = ["crack", "spalling", "efflorescence", "exposed_rebar", "corrosion"]
GATED_LABELS = ["spalling", "efflorescence", "exposed_rebar", "corrosion"]
LABEL_VOCAB = ["crack", "spalling", "efflorescence", "exposed_rebar", "corrosion", "none"]
LABEL_ALIASES = {
    "spallation": "spalling",
    "exposed_bars": "exposed_rebar",
    "corrosion_stain": "corrosion",
}
NON_CONCRETE_SURFACES = ["asphalt", "unpaved", "paving_stones", "sett", "gravel", "mud"]
STRUCTURAL_DOMAINS = ["bridge", "building"]
PAVED_SURFACES = ["asphalt", "concrete", "paving_stones", "sett", "unpaved"]

CONDITION_DESCRIPTORS = {1: "Good", 2: "Satisfactory", 3: "Fair", 4: "Poor", 5: "Serious"}
PRIORITIES = ["none", "monitor", "plan_repair", "urgent"]

IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp"]
IMAGE_SUFFIXES_WIDE = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff"]
CRACK_CLASSES = ["crack", "mildcrack", "severecrack"]

EARTH_RADIUS_TRACK_M = 6_378_137.0
EARTH_RADIUS_STRIP_M = 6_371_008.8
GRAVITY_MPS2 = 9.80665

NON_ROAD_TARGET_PASS_RATE = 0.95
NON_ROAD_MAX_THRESHOLD = 0.45
VOTE_WEIGHT_FLOOR = 1e-6
CLUSTER_K_CANDIDATES = [5, 8, 10, 12, 15, 18, 22, 26, 30]

PROXY_DISCLAIMER = "PCI-like descriptor is a transparent visual proxy, not an official ASTM D6433 PCI."
VISUAL_LIMITATIONS = (
    "Binder content, density/air voids, and water-damage or stripping progression are not "
    "measured; this assessment uses visible image proxies only."
)
START_ONLY_NOTICE = "No timed GPS track was found; map shows only the single start point."
NO_ROUTE_NOTICE = "No GPS track was found; map route is omitted."
SIDECAR_NOTICE = "GPS route from sidecar ("
EMBEDDED_NOTICE = "GPS route from embedded timed metadata ("
SPEED_LABEL_IMU, SPEED_LABEL_NONE, SPEED_LABEL_GPS = "est. (IMU, unreliable)", "(no GPS)", "(GPS)"
IMU_ROUTE_NOTICE = "Route is IMU-estimated (approximate, drifts) - no continuous GPS in source."
MEASURED_ROUTE_NOTICE = "GPS route from measured timed GPS samples."
NO_GPS_NOTICE = "No timed GPS track was found; map route is omitted."
IMU_SPEED_WARNING = (
    "Mean IMU-estimated speed is below 5 km/h for this moving survey; "
    "treat speed and distance as unreliable."
)
DEFECT_XML_ORDER = ["background", "crack", "spallation", "efflorescence", "exposed_bars", "corrosion_stain"]
DEFECT_XML_ALIASES = {
    "background": "background",
    "none": "background",
    "no_defect": "background",
    "corrosion": "corrosion_stain",
    "corrosionstain": "corrosion_stain",
    "corrosion_stains": "corrosion_stain",
    "spalling": "spallation",
    "exposed_rebar": "exposed_bars",
    "exposed_bar": "exposed_bars",
    "exposedbars": "exposed_bars",
    "rebar": "exposed_bars",
    "calcium_leaching": "efflorescence",
}
# --- end of fixed values ----------------------------------------------------
