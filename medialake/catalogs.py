"""Fixed values of the domain: rules, suggestion scores, export profiles, label tables, defaults.

Everything here is a constant that results depend on. The lists are short and fixed, so they are
inlined into expressions as literals; none of them grows with the data.
"""

from __future__ import annotations

# Preset rules as (priority, name, description), highest priority first.
PRESET_RULES = [
    (10, "Track Day", "High contrast, vibrant racing shots"),
    (9, "Night Shooter", "Optimized for low-light night photography"),
    (8, "Portrait Pro", "Professional portrait enhancement"),
    (7, "Landscape Master", "Natural landscape photography"),
    (6, "Urban Edge", "Sharp, modern city photography"),
    (5, "Vintage Film", "Classic film look with natural tones"),
    (4, "Sunset Glow", "Warm, golden hour aesthetics"),
    (3, "Aston Mono", "Monochrome with rich blacks"),
]

# Tag suggestions as (seq, name, base confidence, category).
TAG_SUGGESTIONS = [
    (1, "mountains", 0.95, "location"),
    (2, "forest", 0.87, "location"),
    (3, "urban", 0.76, "location"),
    (4, "coast", 0.68, "location"),
    (5, "landscape", 0.92, "subject"),
    (6, "architecture", 0.81, "subject"),
    (7, "portrait", 0.45, "subject"),
    (8, "street", 0.72, "subject"),
    (9, "vivid", 0.88, "style"),
    (10, "moody", 0.79, "style"),
    (11, "minimal", 0.65, "style"),
    (12, "dramatic", 0.71, "style"),
    (13, "canon", 0.82, "camera"),
    (14, "sony", 0.68, "camera"),
    (15, "nikon", 0.59, "camera"),
    (16, "golden-hour", 0.91, "time"),
    (17, "blue-hour", 0.74, "time"),
    (18, "midday", 0.45, "time"),
]
CAMERA_BOOST = 0.2
LOCATION_BOOST = 0.15
GOLDEN_HOUR_BOOST = 0.25

# Export profiles as (id, name, format, resolution, quality).
EXPORT_PROFILES = [
    ("web", "Web Ready", "JPEG", "1080p", 80),
    ("print", "Print Quality", "TIFF", "Original", 100),
    ("social", "Social Media", "JPEG", "2K", 85),
    ("archive", "Archive", "PNG", "Original", 100),
]

# Export formats on offer as (id, orientation, ratio).
EXPORT_FORMATS = [
    ("9x16", "Portrait", "9:16"),
    ("3x4", "Portrait", "3:4"),
    ("1x1", "Square", "1:1"),
    ("4x3", "Landscape", "4:3"),
    ("16x9", "Landscape", "16:9"),
]

# Id to label tables with the label used when the id is unknown.
FORMAT_LABELS = {"9x16": "9:16 Portrait", "16x9": "16:9 Landscape", "1x1": "1:1 Square"}
FORMAT_DEFAULT = "9:16 Portrait"
CAMERA_LABELS = {
    "sony-a7iv": "Peter's Sony A7iv",
    "canon-r5": "Canon R5",
    "nikon-z6ii": "Nikon Z6 II",
}
CAMERA_DEFAULT = "Camera"
PRESET_LABELS = {
    "none": "None",
    "bw": "Black & White",
    "grain": "Grain + Flares",
    "cinematic": "Cinematic",
    "vintage": "Vintage",
    "clean": "Clean",
}
PRESET_DEFAULT = "None"

# Display names of stored presets, looked up after one file prefix was cut.
PRESET_FILE_PREFIXES = ("AMF1 - ", "AM - ")
PRESET_DISPLAY_NAMES = {
    "AMF1_CHIP_APPROVED": "Chip Approved",
    "AMF1 - 1NEWNAILEDIT": "New Nail Edit",
    "AMF1 - 1NEWER": "Newer",
    "AMF1 - B_W": "Black & White",
    "AMF1 - 1NEW1": "New 1",
    "AMF1 - 2023": "2023",
    "AMF1 - Ayo this do be kinda fire tho": "Ayo Fire",
    "AMF1 - NEUTRAL CLEAN SOFT": "Neutral Clean Soft",
    "AMF1 - Neutral Faded": "Neutral Faded",
    "Soft but grainy teehee 2": "Soft Grainy 2",
    "Soft but grainy teehee": "Soft Grainy",
    "AMF1 - GRIME": "Grime",
    "AMLESSAGGRESSIVE": "Less Aggressive",
    "AMCLEAN": "Clean",
    "AMF1 - ARTSY AF": "Artsy AF",
    "AMF1 - CLEAN AS FUCK": "Clean AF",
    "looksneutraltomehaha": "Neutral",
    "AMF1 - Garage Preset": "Garage",
    "AMF1 - PRESET 3 NO CURVES": "Preset 3 No Curves",
    "AMF1 - JPEG": "JPEG",
    "AMF1 - Preset 2": "Preset 2",
    "AMF1 - Preset 1": "Preset 1",
    "FLADDOCKCLUB": "Paddock Club",
    "FLAT AS FUCK": "Flat AF",
    "Greenedout": "Green Out",
    "Hope Its clean": "Hope Clean",
    "InstagrammyCars": "Instagram Cars",
    "Its green we gooood": "Green Good",
    "NEWSPLITGOODSHIT": "New Split",
    "Noblu": "No Blue",
    "PADDOCK - NEUTRAL_": "Paddock Neutral",
    "PADDOCK": "Paddock",
    "PinkHighlighterYpo": "Pink Highlighter",
    "SEEMS ALRIGHT WFADE": "Seems Alright W/Fade",
    "SEEMS ALRIGHT W_COLOUR": "Seems Alright W/Color",
    "SVJ SPECIAL": "SVJ Special",
    "TEXTURED VINTAGE": "Textured Vintage",
    "WE COOOOL": "We Cool",
    "banegredtion": "Bane Gredtion",
    "bangernicercolopurs": "Banger Nice Colors",
    "basic bitch IG": "Basic IG",
    "beachedas(lessfade)": "Beached As (Less Fade)",
    "beachedas": "Beached As",
    "cars-icywhite": "Cars Icy White",
    "carsicy-lessfadetho": "Cars Icy (Less Fade)",
    "carsicydehaaazed": "Cars Icy Dehazed",
    "carsicywithsomemids": "Cars Icy W/Mids",
    "carsnewsplit": "Cars New Split",
    "carstagramnoblues": "Carstagram No Blues",
    "cityvibes": "City Vibes",
    "cliffvibe": "Cliff Vibe",
    "coolio desat": "Coolio Desat",
    "darkicy": "Dark Icy",
}

# Allowed members of the string enums.
PROJECT_STATUSES = ["draft", "active", "archived"]
PHOTO_STATUSES = ["raw", "processed", "exported", "published"]
UPLOAD_STATUSES = ["queued", "uploading", "paused", "error", "synced"]
MEMBER_ROLES = ["admin", "member", "viewer"]
PLANS = ["free", "pro", "enterprise"]

# Defaults of per-project automation settings. The watermark's text has none here and
# must be given where it is wanted.
AUTOMATION_DEFAULTS = {
    "default_preset_name": None,
    "auto_apply_new": True,
    "retro_apply_existing": False,
    "export_format": "PNG",
    "file_rule": "{project}_{date}_{counter}",
    "counter_start": 1,
    "include_original_name": True,
    "enable_watermark": False,
    "wm_position": "Bottom-Right",
    "wm_opacity": 35,
    "default_tags": "",
    "smart_auto_tagging": False,
    "min_long_edge_px": 2000,
    "min_exposure_quality": 0,
    "auto_flag_low_quality": True,
    "aspects": ["1:1", "4:5", "3:2", "16:9"],
    "storage_channels": [],
    "ai_distribution": False,
    "ai_notes": "",
    "export_scheduling_on": False,
}
TOKEN_TAG_DEFAULT = "general"
TOKEN_ORIGINAL_DEFAULT = "DSC_0123"

# Numbers with a meaning.
MB_PER_PHOTO = 25
GALLERY_WIDTH = 400
GALLERY_HEIGHT = 300
PAGE_CAP = 1000
PLAN_DEFAULT = "free"
HEALTH_KEEP_DAYS = 30
HEALTH_BUCKET_SECONDS = 300
IDLE_SECONDS = 30
FTP_IDLE_SECONDS = 600
NOTES_DEBOUNCE_MS = 600
USER_CERT_DAYS = 90
HOST_CERT_DAYS = 365
EXPIRY_WARNING_DAYS = (7, 15, 30)

# Device tag alphabet, mask and multipliers.
TAG_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
TAG_MASK = 0xDEADBEEF
TAG_MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35)

# Keys a server environment and a field device must set.
REQUIRED_SERVER_KEYS = [
    "POSTGRES_DB",
    "POSTGRES_USER",
    "POSTGRES_PASSWORD",
    "PGRST_DB_URI",
    "PGRST_JWT_SECRET",
]
WANTED_DEVICE_KEYS = ["network_interface", "network_bridge_ip", "ftp_user", "ftp_root"]
PLACEHOLDER = "CHANGE_THIS"
HIDDEN = "***HIDDEN***"
