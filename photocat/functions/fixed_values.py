"""Fixed values the results depend on: tag names, word lists, limits and state names, as plain text."""

# Fixed: which tags supply each caption field, first to last. "EXIF:" stands for EXIF_GROUPS.
FIELD_SOURCES = {
    "title": ["XMP-dc:Title", "IPTC:ObjectName", "XMP-photoshop:Headline", "EXIF:XPTitle"],
    "caption": ["XMP-dc:Description", "IPTC:Caption-Abstract", "EXIF:ImageDescription", "EXIF:XPComment"],
    "notes": ["EXIF:UserComment", "XMP-exif:UserComment", "XMP-photoshop:Instructions", "IPTC:SpecialInstructions"],
    "date": ["XMP-photoshop:DateCreated", "EXIF:DateTimeOriginal", "IPTC:DateCreated", "XMP-exif:DateTimeOriginal"],
    "digitized": ["EXIF:CreateDate", "XMP-xmp:CreateDate", "XMP-exif:DateTimeDigitized", "IPTC:DigitalCreationDate"],
    "creator": ["XMP-dc:Creator", "IPTC:By-line", "EXIF:Artist"],
    "sublocation": ["XMP-iptcCore:Location", "IPTC:Sub-location"],
    "city": ["XMP-photoshop:City", "IPTC:City"],
    "state": ["XMP-photoshop:State", "IPTC:Province-State"],
    "country": ["XMP-photoshop:Country", "IPTC:Country-PrimaryLocationName"],
}
EXIF_GROUPS = ["IFD0", "ExifIFD", "IFD1", "EXIF"]
TEXT_FIELDS = ["title", "caption", "notes", "creator", "sublocation", "city", "state", "country"]
DATE_FIELDS_READ = ["date", "digitized"]
MULTILINE_FIELDS = ["caption", "notes"]
KEYWORD_TAGS = ["XMP-dc:Subject", "IPTC:Keywords"]
CREATOR_TAGS = ["XMP-dc:Creator", "IPTC:By-line", "EXIF:Artist"]
ORIGINAL_DATE_TAGS = ["EXIF:DateTimeOriginal", "XMP-exif:DateTimeOriginal"]
LISTING_SKIPPED = ["System:", "File:", "ExifTool:"]

# Fixed: where a changed field is written: primary tag, mirrors already in the file, fallbacks cleared.
MIRROR_SPEC = {
    "title": ("XMP-dc:Title", ["IPTC:ObjectName", "EXIF:XPTitle"], ["XMP-photoshop:Headline"]),
    "caption": ("XMP-dc:Description", ["IPTC:Caption-Abstract", "EXIF:ImageDescription"], ["EXIF:XPComment"]),
    "notes": ("ExifIFD:UserComment", ["XMP-exif:UserComment"],
              ["XMP-photoshop:Instructions", "IPTC:SpecialInstructions"]),
    "creator": ("XMP-dc:Creator", ["IPTC:By-line", "EXIF:Artist", "EXIF:XPAuthor"], []),
    "sublocation": ("XMP-iptcCore:Location", ["IPTC:Sub-location"], []),
    "city": ("XMP-photoshop:City", ["IPTC:City"], []),
    "state": ("XMP-photoshop:State", ["IPTC:Province-State"], []),
    "country": ("XMP-photoshop:Country", ["IPTC:Country-PrimaryLocationName"], []),
}
# Fixed: the most bytes each tag can hold.
IPTC_MAX_BYTES = {
    "IPTC:ObjectName": 64, "IPTC:Caption-Abstract": 2000, "IPTC:By-line": 32, "IPTC:Sub-location": 32,
    "IPTC:City": 32, "IPTC:Province-State": 32, "IPTC:Country-PrimaryLocationName": 64,
    "IPTC:SpecialInstructions": 256, "IPTC:Keywords": 64,
}
EXIF_JPEG_MAX_BYTES = 16000
# Fixed: tags removed when a date is cleared.
DATE_CLEARED_TAGS = [
    "ExifIFD:DateTimeOriginal", "XMP-exif:DateTimeOriginal", "XMP-photoshop:DateCreated", "IPTC:DateCreated",
    "IPTC:TimeCreated", "ExifIFD:OffsetTimeOriginal", "ExifIFD:SubSecTimeOriginal",
]

# Fixed: months, weekdays and words in written dates.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
YEAR_PART_WORDS = ["early", "mid", "late", "spring", "summer", "autumn", "fall", "winter"]
DATE_FORMAT_FIELDS = ["yyyy", "mmmm", "mmm", "yy", "mm", "dd", "m", "d"]
FIRST_YEAR = 1000
# Fixed: what each level of detail is marked as, sure and estimated.
LEVEL_PATTERNS = {"day": "Y!M!D!", "month": "Y!M!", "year": "Y!", "circa": "Y~"}
ESTIMATED_PATTERNS = {"day": "Y!M!D~", "month": "Y!M~", "year": "Y~", "circa": "Y~"}

# Fixed: a log file is full at this size.
LOG_ROLL_BYTES = 10 * 1024 * 1024

# Fixed: limits of an edit set.
MAX_TEXT, MAX_LINE, MAX_KEYWORDS, MAX_KEYWORD, MAX_FACES, MAX_CREATORS = 65536, 2000, 500, 200, 500, 50

# Fixed: supported file extensions and the extension of each format.
SUPPORTED_EXTENSIONS = [".tif", ".tiff", ".jpg", ".jpeg", ".png"]
FORMAT_NAMES = {"tiff": "TIFF", "tif": "TIFF", "jpeg": "JPEG", "jpg": "JPEG", "png": "PNG"}
FORMAT_EXTENSIONS = {"TIFF": ".tif", "JPEG": ".jpg", "PNG": ".png"}
MANAGED_FOLDERS = ["_originals", "captioned"]

# Fixed: row labels of a group photo, and the label when there are too few.
ROW_LABELS = ["Front row, L–R: ", "Middle row, L–R: ", "Back row, L–R: "]

# Fixed: file names that are not allowed, and characters that are.
RESERVED_STEMS = ["CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$", "CLOCK$"] + [
    p + n for p in ("COM", "LPT") for n in "0123456789¹²³"
]
FILE_NAME_BYTES = 200

# Fixed: words in a device name that mean a scanner.
SCANNER_WORDS = ["scan", "perfection", "canoscan", "plustek", "opticfilm", "fujitsu", "coolscan", "imacon",
                 "flextight", "microtek", "reflecta", "visioneer", "avision", "doxie", "expression 1", "v600",
                 "v850", "v700", "v550", "v370", "v39"]
# Fixed: thresholds of the scan cues and of readable text.
TILT, SOFT_EDGE, DRIFT, TEXTURE_NOISE, FLAT_NOISE, HIGH_DPI, SCAN_SCORE = 0.12, 1.5, 2.0, 1.5, 0.3, 300, 2.0
WORD_CONFIDENCE, COMPANION_CONFIDENCE, WRITING_THICKNESS = 0.5, 0.6, 0.01
EDGE_UNSURE, WEAK_READ = 0.6, 0.6

# Fixed: journal states.
TERMINAL_STATES = ["done", "failed", "skipped", "changed", "excluded", "held", "blocked", "notPrepared"]
UNSAVED_STATES = {"skipped": "skipped", "blocked": "blocked", "error": "blocked", "excluded": "excluded",
                  "flagged": "held", "held": "held", "pending": "notPrepared", "unchecked": "skipped"}
PROTECTED_STATES = ["done", "running", "restored"]

# Fixed: similarity a lossy copy must reach.
LOSSY_MAX_MAD, LOSSY_MIN_PSNR = 6.0, 28.0
DRAFT_DAYS = 60
STAGING_IDLE = "10 minutes"
# Fixed: share of the newest estimate in the smoothed time left, and results needed before one.
ETA_NEW_SHARE, ETA_MIN_DONE = 0.35, 2

# Fixed: why a batch leaves a photo alone or marks it, as users read it.
BATCH_REASONS = {
    "multi": "Multi-page TIFF: saving would drop the extra pages",
    "unsupported": "unsupported file",
    "copy": "a captioned copy made earlier",
    "maybe_copy": "may be a captioned copy",
    "edge": "not sure where the photo ends (check its edge)",
    "over": "text printed over the photo (left untouched)",
    "refused": "caption on the scan: overwriting it is off",
    "own": "already captioned",
    "existing": "has an existing caption",
    "names": "no names found",
    "weak": "some existing caption text was hard to read",
}

# Fixed: phrases of read errors (lower case) that mean an empty and a damaged file.
EMPTY_FILE_PHRASES = ["empty file", "file is empty", "zero byte", "zero-byte"]
DAMAGED_FILE_PHRASES = [
    "cannot identify", "corrupt", "damaged", "decod", "invalid jpeg", "invalid png", "invalid tiff", "not a supported", "not a valid",
    "not an image", "premature end", "truncated", "unexpected end", "unsupported file type",
]
