"""Matching offers to a shopper's query: intent, category, score, reasons, admission.

A query is read once, on the driver, into an intent; the score is an expression made from it. For a table of many queries
the same expressions run on columns of intents.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylens.functions.text import MODEL_PATTERN, models, plain_text, tokens
from quaylens.operators import described
from quaylens.operators.offers import newest

# What a violated expectation leaves of a score, and the bounds of exact and doubtful matches.
LEFT_BY = {"kind": 0.2, "accessory": 0.12, "variant": 0.82, "model": 0.2, "principal": 0.05, "ram": 0.2, "carrier": 0.2, "subject": 0.2}
EXACT, DOUBTFUL, CONDITION_COST, FLOOR = 0.92, 0.69, 0.15, 0.35
STOP_WORDS = frozenset("for with and the from compatible replacement new used original model in on of a an to by".split())
#: Words and phrases of a text that offers an accessory.
ACCESSORY_TERMS = (
    "case", "cover", "faceplate", "faceplates", "face plate", "face plates", "side shell plate", "side shell plates", "replacement shell", "screen protector", "protector", "charger", "cable", "adapter",
    "disc drive", "disk drive", "optical drive", "blu ray drive", "vertical stand", "replacement stand", "stand", "حامل",
    "usb hub", "expansion hub", "multiport hub", "hub", "docking station", "port expander", "هب", "موزع منافذ",
    "atomizer", "perfume bottle", "empty bottle", "laptop sleeve", "laptop sling", "laptop bag", "laptop briefcase", "briefcase", "rucksack", "notebook sleeve", "notebook sling", "cooling fan", "cpu fan", "protective shell", "privacy screen", "active pen", "lcd replacement", "screen replacement", "only compatible with", "laptop battery", "notebook battery", "battery replacement", "battery compatible", "battery for", "replacement battery", "power supply", "power supplies", "laptop screen", "replacement screen", "replacement display", "display panel", "lcd panel", "lcd screen",
    "حافظه", "كفر", "شاحن", "كيبل", "سلك", "حمايه", "لزقه", "غطاء", "اغطيه", "مروحه تبريد", "حامل جداري", "حامل حائط", "قارئ اقراص", "هارد خارجي", "قرص صلب خارجي",
)
#: Further words of accessories and fastenings.
ACCESSORY_WORDS = ("strap", "bolt", "gear")
ACCESSORY = rf"(?:^| )(?:{'|'.join((*ACCESSORY_TERMS, *ACCESSORY_WORDS))})(?= |$)"
VARIANT_WORDS = ("pro", "max", "plus", "ultra", "air", "fold", "flip", "fe", "برو", "ماكس", "بلس", "الترا", "اير")
# single words are looked up in an offer's words; phrases are searched for only where one's first word is there
_SINGLE = tuple(t for t in (*ACCESSORY_TERMS, *ACCESSORY_WORDS) if " " not in t)
_PHRASES = tuple(t for t in ACCESSORY_TERMS if " " in t)
_OPENING = tuple(dict.fromkeys(t.split()[0] for t in _PHRASES))
CARRIERS = r"(?i)\(\s*(?:at\s*&\s*t|verizon|t[- ]mobile)\s*\)"
CARRIER_ASKED = r"(?i)\bat\s*&\s*t\b|\bverizon\b|\bt[- ]mobile\b"
LAPTOP_LINES = ("pavilion", "elitebook", "probook", "spectre", "envy", "omnibook", "victus", "omen", "latitude", "thinkpad", "ideapad", "zenbook", "vivobook", "macbook", "chromebook")
LAPTOP_PARTS = ("intel", "amd", "ryzen", "core", "celeron", "pentium", "ram", "memory", "ssd", "windows", "processor")
#: The words by which a text is of a category; the first row that has one is the text's. One category has two rows.
CATEGORY_WORDS: tuple[tuple[str, str], ...] = (
    (
        "accessory",
        r"mouse|keyboard|charger|cable|adapter|adaptor|cases?|covers?|protector|cartridge|toner|ink|controller|dualsense|charging station|stick module|remote|gift card|hubs?|docking stations?|port expanders?|atomizer|perfume bottle|empty bottle|laptop screen|replacement screen|replacement display|display panel|lcd panel|lcd screen|backpacks?|briefcases?|rucksacks?|(?:laptop|notebook) (?:sleeves?|slings?|bags?|cases?|pouches?)|(?:cpu |laptop |notebook )?(?:cooling|replacement) fans?|cpu fans?|protective shells?|privacy screens?|active pens?|(?:lcd|led lcd|screen) replacements?|only compatible with|(?:laptop|notebook) batter(?:y|ies)|(?:replacement|compatible|spare) batter(?:y|ies)|batter(?:y|ies) (?:replacement|compatible|for)|power suppl(?:y|ies)|stylus|stylus pen|photo paper|printhead|print head|ssds?|nvme|solid state drives?|storage expansion(?: drives?)?",
    ),
    ("laptop", r"laptops?|notebooks?|macbook|chromebook|zenbook|vivobook|thinkpad|ideapad|elitebook|probook|omnibook|spectre|envy|pavilion|inspiron|latitude|loq"),
    ("printer", r"printers?|laserjet|deskjet|officejet|ecotank|smart tank"),
    ("desktop", r"desktop|imac|mac mini|all in one|tower pc|optiplex|prodesk"),
    ("phone", r"phones?|smartphone|iphone|galaxy s\d+|galaxy a\d+|galaxy z|pixel \d+"),
    ("tablet", r"tablets?|ipad|galaxy tab|surface pro"),
    ("tv", r"tv|television|bravia|oled tv|qled tv"),
    ("monitor", r"monitors?|display screen"),
    ("audio", r"headphones?|earphones?|earbuds?|airpods|headset|speaker|soundbar|walkman"),
    ("jewelry", r"jewelry|jewellery|necklaces?|pendants?|bracelets?|bangles?|earrings?|rings?|brooch(?:es)?|charms?"),
    ("watch", r"watch|smartwatch"),
    ("camera", r"camera|dslr|mirrorless|eos"),
    ("vacuum", r"vacuum|hoover|dyson v\d+"),
    ("beauty", r"airwrap|supersonic|hair dryer|straightener|shaver|trimmer"),
    ("appliance", r"refrigerator|fridge|washer|washing machine|dryer|dishwasher|oven|microwave|air conditioner|purifier|blender|kettle|coffee maker"),
    ("network", r"router|modem|wifi|wi fi|network switch"),
    ("projector", r"projector"),
    ("coffee", r"coffee|ground coffee|coffee beans"),
    ("clothing", r"clothing|fashion|dress(?:es)?|abaya|shirts?|tees?|t shirts?|hoodies?|pants?|jeans|jackets?|coats?|sweaters?|skirts?|blouses?|abito|abiti|robe|robes|kleid|kleider|vestido|vestidos|vestito|vestiti"),
    ("shoes", r"shoes?|sneakers?|boots?|sandals?|heels?|slippers?|loafers?"),
    ("bag", r"bags?|handbags?|backpacks?|luggage|wallets?|purses?|totes?"),
    ("beauty", r"makeup|cosmetics?|skincare|skin care|lipstick|mascara|foundation|serum|moisturizer|hair care"),
    ("perfume", r"perfumes?|fragrances?|eau de parfum|eau de toilette|eau de cologne|parfums?|edp|edt|cologne"),
    ("furniture", r"furniture|sofas?|couches?|chairs?|tables?|desks?|beds?|wardrobes?|cabinets?"),
    ("kitchen", r"kitchen|cookware|pans?|pots?|cutlery|tableware|air fryer|toaster|cooktop"),
    ("home", r"home decor|bedding|duvet|pillows?|curtains?|rugs?|storage organizer|lighting|lamp"),
    ("sports", r"sports?|fitness|gym|running|football|soccer|basketball|cycling|camping|hiking"),
    ("toy", r"toys?|dolls?|lego|building blocks|plush|kids game"),
    ("baby", r"baby|infant|stroller|diaper|feeding bottle|car seat"),
    ("pet", r"pet|pets|cat food|dog food|cat litter|pet toy|pet bed"),
    ("automotive", r"automotive|car accessories|car part|engine oil|tire|tyre|brake|wiper"),
    ("book", r"books?|paperback|hardcover|kindle"),
    ("grocery", r"grocery|groceries|snacks?|chocolate|tea|rice|pasta|cereal|spices?"),
    ("office", r"office supplies|stationery|notebook|pens?|pencils?|paper shredder"),
    ("tool", r"drill|saw|screwdriver|power tool"),
)
#: Words that end the principal part of a title: what follows is only included.
INCLUDED = r" (?:with|including|includes|con|avec|mit) "
#: The categories that a brand is looked for in, the main one first.
BRAND_CATEGORIES: dict[str, tuple[str, ...]] = {
    "hp": ("laptop", "printer", "desktop", "monitor"),
    "dell": ("laptop", "desktop", "monitor"),
    "lenovo": ("laptop", "desktop", "tablet", "monitor"),
    "asus": ("laptop", "desktop", "monitor", "network"),
    "acer": ("laptop", "monitor", "desktop"),
    "msi": ("laptop", "desktop", "monitor"),
    "apple": ("phone", "laptop", "tablet", "watch", "audio", "desktop"),
    "samsung": ("phone", "tv", "tablet", "monitor", "appliance", "audio"),
    "sony": ("tv", "console", "audio", "camera", "game"),
    "microsoft": ("laptop", "console", "accessory"),
    "nintendo": ("console", "game", "accessory"),
    "canon": ("camera", "printer"),
    "nikon": ("camera",),
    "epson": ("printer", "projector"),
    "brother": ("printer",),
    "dyson": ("vacuum", "beauty", "appliance"),
    "lg": ("tv", "appliance", "monitor", "audio"),
    "bosch": ("appliance", "tool"),
    "logitech": ("accessory", "audio"),
    "jbl": ("audio",),
    "bose": ("audio",),
    "huawei": ("phone", "tablet", "watch", "audio", "laptop"),
    "xiaomi": ("phone", "tablet", "watch", "appliance", "audio"),
    "honor": ("phone", "tablet", "laptop", "watch", "audio"),
    "oneplus": ("phone", "tablet", "audio"),
    "oppo": ("phone", "tablet", "audio"),
    "realme": ("phone", "tablet", "audio"),
    "nokia": ("phone", "tablet"),
    "swarovski": ("jewelry", "watch", "other", "accessory"),
    "dior": ("perfume", "beauty", "clothing", "bag", "jewelry"),
    "chanel": ("perfume", "beauty", "bag", "clothing", "jewelry"),
    "gucci": ("bag", "clothing", "shoes", "perfume", "jewelry"),
    "prada": ("bag", "clothing", "shoes", "perfume"),
    "hermes": ("bag", "perfume", "clothing", "jewelry"),
    "cartier": ("jewelry", "watch", "perfume"),
    "rolex": ("watch",),
    "tiffany": ("jewelry", "watch"),
    "bulgari": ("jewelry", "watch", "perfume"),
    "shein": ("clothing", "shoes", "bag", "beauty", "home", "jewelry"),
    "nike": ("shoes", "clothing", "sports"),
    "adidas": ("shoes", "clothing", "sports"),
    "zara": ("clothing", "shoes", "bag"),
    "hm": ("clothing", "home"),
    "ikea": ("furniture", "home", "kitchen"),
    "sephora": ("beauty", "perfume"),
    "namshi": ("clothing", "shoes", "bag", "beauty", "sports"),
    "centrepoint": ("clothing", "shoes", "bag", "home", "toy", "baby"),
    "maxfashion": ("clothing", "shoes", "bag", "baby", "home"),
    "decathlon": ("sports", "shoes", "clothing", "bag"),
    "niceone": ("beauty", "perfume", "grocery"),
}
# How far a brand's own categories lift an offer of a query that names only the brand, and what others leave.
BRAND_LIFT, BRAND_STEP, BRAND_LEAST, OTHER_CATEGORY = 0.24, 0.04, 0.08, 0.3
# What a sold title must say where a query asks for it.
ATHLETIC = r"\b(?:athletic|running|runners?|training|trainers?|sneakers?|basketball|tennis|football|soccer|jogging|gym|fitness|cleats?|sports? (?:shoes?|sneakers?|trainers?))\b"
MALE_ASKED, MALE, FEMALE = r"\b(?:men|mens|male|masculine)\b", r"\b(?:men|mens|male|masculine|homme|for him)\b", r"\b(?:women|womens|femme|for her|ladies)\b"
SERIES_ASKED = r"\b(?:apple watch series|watch apple series) [1-9]\d?\b"
WHOLE_WATCH = (
    r"^(?:apple )?watch series [1-9]\d?\b",
    r"\b(?:gps|cellular|lte)\b",
    r"\b(?:aluminum|aluminium|titanium|stainless steel) case\b|\b(?:gps smartwatch|smartwatch gps|cellular smartwatch)\b",
    r"\b(?:38|40|41|42|44|45|46|49)mm\b",
)
WATCH_PART = r"\b(?:replacement|compatible|case cover|fit case|screen protector|screen protection|protector|bumper|wrist strap|watch band|beginner|user guide|handbook)\b"
HEADPHONES, SPEAKERS, SPEAKER_SOLD = r"\b(?:headphones?|headsets?|earphones?|earbuds?|airpods)\b", r"\b(?:speakers?|soundbars?)\b", r"\b(?:speakers?|soundbars?|boombox(?:es)?)\b"
PHONE_FIRST, PHONE_PART = r"^(?:(?:apple )?iphone \d+|samsung galaxy s\d+)", r"\b(?:cases?|covers?|chargers?|protectors?|replacement|repair)\b"


@dataclass(frozen=True)
class Whole:
    """A whole product that a query asks for, unless it names a part; what of a title's subject sells only a part, a copy or a book.

    `proof` in the subject, or in what of it stands before the part, says that the whole is sold all the same.
    """

    asked: str
    unless: str
    part: str
    proof: str | None = None
    before: bool = False


#: The whole products, their parts and the proofs against them.
WHOLE_PRODUCTS = (
    Whole(
        r"\b(?:camera|mirrorless|dslr)\b|كاميرا كانون",
        r"\b(?:lens(?:es)?|straps?|wristbands?|bags?|cases?|covers?|tripods?|filters?|guides?|manuals?|books?|tutorials?|setup)\b|عدسه|حقيبه|حزام|غطاء|فلتر|كتاب|دليل",
        r"\b(?:user manual|user guide|guida utente|guia del usuario|guía del usuario|manual de usuario|pocket guide|quick setup|master your|mastering|ultimate guide|complete guide|secrets and techniques|gimbal stabilizer|lens(?:es)?|straps?|hand strap|wrist strap|sling bag|crossbody bag|kameratasche|camera bag|camera case|tripod)\b|كتاب|دليل",
        r"\beos r\d+\b.*\bmirrorless camera\b|\b(?:mirrorless|digital) camera (?:kit|body)\b|\bcamera body\b|\bmirrorless camera $",
        before=True,
    ),
    Whole(
        r"\b(?:dyson v\d+|vacuum cleaner)\b|مكنسه دايسون",
        r"\b(?:toys?|pretend|children|kids?|filters?|attachments?|extension wand|replacement wands?|mattress tools?|mop heads?|trigger locks?|mount holders?|accessory holders?|docking stands?|cleaner head|floor tool|replacement parts?|holders?|hoses?|dust bins?|dustbins?|cyclones?|cyclone assemblies?|runner spares?|body|brushes?|accessories|spare parts?)\b|فلتر|ملحق|فرشاه|انبوب|قطعه",
        r"\b(?:accessories mount holder|accessory holder|mount holder|replacement filters?|filter element|filter replacement|filter accessories|mattress tool|replacement wand|replacement rod|extension wand|cyclone assembly|runner spare|trigger lock|electric mop head|mop head attachment|vacuum attachments?|soft roller brush|brush replacement|docking stand|vacuum cleaner accessories|vacuum cleaner hoses?|replacement (?:vacuum cleaner )?hoses?|hose for dyson|vacuum cleaner attachments?|attachment accessories kit|accessories kit replacement|dust bin replacement|dustbin replacement|vacuum cleaner floor brush|floor brush head|cleaner head|floor tool|vacuum cleaner holder|vacuum cleaner main body|main body (?:and )?cyclone|vacuum replacement cyclone|dryer vent cleaner kit|pretend play|toy vacuum|vacuum toy|kids? pretend|childrens? toy)\b",
    ),
    Whole(r"\bdyson v\d+\b", r"\b(?:compatible|for dyson)\b", r"\bcompatible to\b|\bfor dyson\b|\beufy\b", r"^dyson v\d+\b.*\b(?:vacuum cleaner|cordless vacuum)\b"),
    Whole(
        r"\b(?:office chair|chair office)\b|كرسي مكتب",
        r"\b(?:repair|clamp|bracket|caster|wheels?|miniature|model|replacement|fix|headrests?|armrests?|cushions?|mats?|gas lifts?|spare parts?|hydraulic cylinders?|chair savers?)\b|اصلاح|عجلات|مشبك|تصليح",
        r"\b(?:fix sinking chair kit|office chair saver|replace swivel caster wheels|caster wheel replacement|replacement caster|stationary foot|headrest attachment|head cushion pillow attachment|armrest cushions?|elbow pillow|chair spare parts|gas lift hydraulic|gas lift pneumatic|chair gas lift cylinder|office chair mat|floor protectors for rolling chairs|camping cot|portable recliner chair|miniatures?|dollhouse|1 100|sagging fix clamp|fix clamp|repair clamp|height lock bracket)\b",
    ),
    Whole(r"\b(?:office chair|chair office)\b|كرسي مكتب", r"\b(?:folding|student)\b", r"\b(?:folding chair|student chair)\b", r"\boffice chair\b"),
    Whole(
        r"\b(?:coffee beans|coffee coffee)\b|بن قهوه|حبوب قهوه",
        r"\b(?:spray|sprayer|stickers?|bottle|grinder|labels?|mugs?|filters?|books?|cups?)\b|كوب|كتاب|فلتر|بخاخ|ملصق|مطحنه",
        r"\b(?:pour over premium coffee set|pour over coffee set|coffee brewing set|coffee dripper|coffee server|barista tools|coffee brewing tools|book for coffee lovers|little book for coffee lovers|treatise on the nature|coffee and poetry|coffee poetry|coffee mugs?|coffee cups?|book of coffee|coffee filter|coffee cupping|coffee art|coffee grinder|luggage cup holder|sprayer|spray bottle|empty makeup|empty bottle|stickers?|3d stickers|coffee cup sticker)\b|كوب|اكواب|مطحنه|كتاب قهوه|فلتر قهوه",
    ),
    Whole(
        r"\b(?:apple watch|watch apple)\b|ساعه ابل",
        r"\b(?:straps?|wristbands?|bands?|loops?|cases?|chargers?|glass|screen|protector|bracelets?|guides?|manuals?|books?)\b|سوار|شاحن|حمايه|زجاج|غطاء",
        r"\b(?:funda protectora|protectora de pantalla|solo loop band|stretch solo loop|comparison guide|guide for seniors|mastering guide|step by step manual|band for apple watch|front glass replacement|display glass|tempered glass|tpu film|screen protector|replacement glass|straps?|wristbands?|sport loop|braided loop|watch bands?|replacement bands?)\b",
    ),
    Whole(
        r"\b(?:apple watch|watch apple)\b|ساعه ابل",
        r"\b(?:guides?|manuals?|books?)\b",
        r"\b(?:for beginners|beginners guide|seniors guide|visual guide|user guide|user manual|instruction manual|handbook|step by step guide|how to use)\b",
        r"\b(?:gps smartwatch|smartwatch|watch body|gps cellular|aluminum case|titanium case)\b",
    ),
    Whole(
        r"\bps5\b.*\b(?:disc drive|optical drive)\b|\b(?:disc drive|optical drive)\b.*\bps5\b",
        r"\b(?:housings?|shell|repair|connector|modules?|travel|case|replacement parts?)\b|قطع|هيكل|موصل|تصليح",
        r"\b(?:disc drive module|disc drive connector|optical disc drive connector|connector module|kem 497aaa|replacement optical disc drive module|empty shell|shell housing|drive housing|housings?|connector replacement|repair kit|travel case)\b",
    ),
)


def category_of(text: str) -> str | None:
    """The category of a normal text."""
    return next((c for c, p in CATEGORY_WORDS if re.search(rf"\b(?:{p})\b", text)), None)


def category(text: Column) -> Column:
    """The same for a column of texts; null if no category's word is there."""
    plain = plain_text(text)
    return F.coalesce(*[F.when(plain.rlike(rf"\b(?:{p})\b"), F.lit(c)) for c, p in CATEGORY_WORDS])


def principal(text: Column) -> Column:
    """The principal part of a title: what is sold, before what is only included. What it is compatible with isn't included."""
    fits = F.regexp_replace(plain_text(text), r"\bcompatible with\b", "compatible to")
    return F.split(F.concat(F.lit(" "), fits, F.lit(" ")), INCLUDED)[0]


def sold_role(text: Column) -> Column:
    """accessory or product, by the principal part of a title."""
    return F.when(F.rtrim(principal(text)).rlike(ACCESSORY), "accessory").otherwise("product")


def ram_gb(text: Column) -> Column:
    """The memory in GB that a normal text names as such."""
    either = F.regexp_extract(text, r"\b(\d{1,3})(?:gb)?(?: (?:ddr[345]|lpddr[345]x?|memory)){0,2} ram\b", 1)
    return F.when(either != "", either.cast("int")).otherwise(F.regexp_extract(text, r"\bram (\d{1,3})(?:gb)?\b", 1).try_cast("int"))


@dataclass(frozen=True)
class Intent:
    text: str
    tokens: tuple[str, ...]
    category: str | None = None
    storage: str | None = None
    color: str | None = None
    condition: str | None = None
    accessory: bool = False
    variants: tuple[str, ...] = field(default=())
    model: str | None = None
    ram: int | None = None
    carrier: bool = False
    brand: str | None = None
    kind: str | None = None
    mode: str = "specific"
    provider_query: str = ""

    @property
    def wanted_category(self) -> str | None:
        """The category, or for consoles and their games the kind."""
        return self.kind if self.kind in ("console", "game") else self.category


def parse_intent(text: str, categories: tuple[str, ...] | None = None, colors: tuple[str, ...] = ()) -> Intent:
    """What a query asks for. The category's word isn't a token to be matched: it is held against the offer's category.

    `categories` names the words that are categories themselves; without it a category is found by CATEGORY_WORDS. `mode` is
    brand, category or general for a query that names no more than that, else specific. `provider_query` is what to ask a
    merchant: without the condition, and without the use of a brand's shoes, which only the shopper's own query holds offers to.
    """
    carrier = bool(re.search(CARRIER_ASKED, text))
    plain = re.sub(r"(\d+) (gb|tb|mb)\b", r"\1\2", " ".join(re.sub(r"[^\w]+|_", " ", text.lower()).split()))
    plain = re.sub(r"\b(?:playstation|play station|ps) ?([45])\b", r"ps\1", plain)
    words = [w for w in plain.split() if w not in STOP_WORDS]
    if categories is None:
        category = category_of(plain)
        structural = next((p for c, p in CATEGORY_WORDS if c == category and re.search(rf"\b(?:{p})\b", plain)), None)
        named = re.search(rf"\b(?:{structural})\b", plain) if structural else None
        gone = set(named[0].split()) if named else set()
    else:
        category = next((w for w in words if w in categories), None)
        structural = re.escape(category) if category else None
        gone = {category}
    kind = described.asked_kind(plain)
    if kind in ("console", "game"):  # its words are the platform's, and the kind is held against the offer's
        category, gone = None, set()
    brand = next((b for b in BRAND_CATEGORIES if f" {b} " in f" {plain} "), None)
    memory = re.search(r"\b(\d{1,3})(?:gb)?(?: (?:ddr[345]|lpddr[345]x?|memory)){0,2} ram\b|\bram (\d{1,3})(?:gb)?\b", plain)
    without_memory = plain.replace(memory[0], " ") if memory else plain
    storage = next((w for w in without_memory.split() if re.fullmatch(r"\d+(gb|tb)", w)), None)
    color = next((w for w in words if w in colors), None)
    condition = next((m[0] for m in [re.search(r"\b(refurbished|used|new)\b", plain)] if m), None)
    model = re.search(MODEL_PATTERN, plain)
    wanted = tuple(dict.fromkeys(w for w in words if w not in gone))
    residual = [w for w in (re.sub(rf"\b(?:{structural})\b", " ", plain) if structural else plain).split() if w != brand]
    broad = not residual or (not brand and not category and len(residual) == 1)
    specific = kind or model or re.search(r"\b\d+(?:gb|tb)\b", plain) or not broad
    mode = "specific" if specific else "brand" if brand else "category" if category else "general"
    asked = " ".join(re.sub(r"\b(?:refurbished|used|new)\b", " ", plain).split())
    if category == "shoes" and brand and sorted(asked.split()) == sorted((brand, "shoes", "sports")):
        asked = f"{brand} shoes"
    return Intent(
        plain, wanted, category, storage, color, condition, bool(re.search(ACCESSORY, plain)) or "accessory" in (category, kind), tuple(w for w in words if w in VARIANT_WORDS), model[0] if model else None,
        int(memory[1] or memory[2]) if memory else None, carrier, brand, kind, mode, asked,
    )


def fallback_queries(intent: Intent) -> list[str]:
    """What else to ask a merchant when the first query brings too little, in order: a brand's main categories for a query of just the brand; the model; without storage and colour; brand with category, brand, category. The condition stays."""
    worn = f" {intent.condition}" if intent.condition else ""
    category, brand, detail = intent.wanted_category, intent.brand, intent.storage or intent.color
    out = []
    if intent.mode == "brand" and brand and not category and not intent.model:
        out += [f"{brand} {c}" for c in BRAND_CATEGORIES[brand][:4]]
    if intent.model and ((category and intent.provider_query != intent.model) or detail):
        out.append(intent.model + worn)
    out.append(" ".join(w for w in intent.provider_query.split() if w not in (intent.storage, intent.color)))
    if brand and category:
        out.append(f"{brand} {category}{worn}")
    if brand and (detail or category):
        out.append(brand + worn)
    if category and detail:
        out.append(category + worn)
    return [q for q in dict.fromkeys(out) if len(q) >= 2 and q != intent.provider_query]


def relaxed(intent: Intent) -> list[str]:
    """Wider queries, in the order in which to try them: without storage, without colour, brand and category, category."""
    drop = lambda *gone: " ".join(t for t in intent.tokens if t not in gone)
    with_category = lambda t: " ".join(x for x in (t, intent.category) if x)
    out = [with_category(drop(intent.storage)), with_category(drop(intent.storage, intent.color)), with_category(intent.tokens[0] if intent.tokens else ""), intent.category or ""]
    return [q for q in dict.fromkeys(out) if q and q != intent.text]


def _names_accessory(words: Column, text: Column) -> Column:
    """Whether a normal text, split into its words, names an accessory."""
    one_of = lambda these: F.arrays_overlap(words, F.array(*[F.lit(w) for w in these]))
    return one_of(_SINGLE) | (one_of(_OPENING) & text.rlike(rf"(?:^| )(?:{'|'.join(_PHRASES)})(?= |$)"))


def _subject(title: Column) -> Column:
    """The part of a normal title before what is only included."""
    return F.trim(F.split(F.concat(F.lit(" "), title, F.lit(" ")), INCLUDED)[0])


def _read(offers: DataFrame, intent: Intent) -> DataFrame:
    """What is read of an offer's texts, once: _title, _said (with brand and the address's path), then _sold, _words, _named, _sizes, _memory; _kind where the query asks for one."""
    title = F.col("_title")
    path = F.coalesce(F.try_url_decode(F.regexp_extract("source_url", r"^https?://[^/?#]+(/[^?#]*)", 1)), F.lit("")) if "source_url" in offers.columns else F.lit("")
    rows = offers.withColumn("_title", described.console_text(F.col("title"))).withColumn("_said", F.trim(F.concat_ws(" ", "_title", plain_text(F.concat_ws(" ", "brand", path)))))
    rows = rows.withColumns({"_sold": _subject(title), "_words": F.split("_said", " "), "_named": models(title), "_sizes": F.regexp_extract_all(title, F.lit(r"[0-9]+(?:gb|tb)"), F.lit(0)), "_memory": ram_gb(title)})
    if not intent.kind:
        return rows.withColumn("_kind", F.lit(None).cast("string"))
    own = {c: f"_own_{c}" for c in described.COLUMNS if c in offers.columns}
    read = {c: F.lit(None).cast("string") for c in ("model_number", "storage", "source_url") if c not in offers.columns}
    told = described.describe(rows.withColumnsRenamed(own).withColumns(read)).withColumn("_kind", F.col("kind"))
    return told.drop(*described.COLUMNS, *read).withColumnsRenamed({v: k for k, v in own.items()})


def _proofs(intent: Intent) -> dict[str, Column]:
    """The words of a query that only the sold title can prove, and the proof: an athletic use of shoes, a perfume for men."""
    title, out = F.col("_title"), {}
    if intent.category == "shoes" and "sports" in intent.tokens:
        out["sports"] = title.rlike(ATHLETIC)
    if intent.category == "perfume" and re.search(MALE_ASKED, intent.text):
        out["men"] = title.rlike(MALE) & ~title.rlike(FEMALE)
    return {w: F.coalesce(c, F.lit(False)) for w, c in out.items()}


def _whole_watch() -> Column:
    subject = F.col("_sold")
    proofs = [subject.rlike(p) for p in WHOLE_WATCH]
    return F.coalesce(proofs[0] & proofs[1] & proofs[2] & proofs[3] & ~subject.rlike(WATCH_PART), F.lit(False))


def _only_a_part(intent: Intent) -> Column:
    """Whether a title sells only a part of the whole product that a query asks for."""
    subject, out = F.trim(principal(F.col("title"))), F.lit(False)
    for w in WHOLE_PRODUCTS:
        if re.search(w.asked, intent.text) and not re.search(w.unless, intent.text):
            proven = F.split(subject, w.part)[0].rlike(w.proof) if w.before else subject.rlike(w.proof) if w.proof else F.lit(False)
            out = out | (subject.rlike(w.part) & ~proven)
    return out


def _flags(intent: Intent) -> dict[str, Column]:
    """What an offer (title, brand, category, condition, storage; source_url and model_number if there), once read, violates of an intent, by name; a flag is never null."""
    title, subject, words = F.col("_title"), F.col("_sold"), F.col("_words")
    any_of = lambda these: F.arrays_overlap(words, F.array(*[F.lit(w) for w in these]))
    asked = lambda pattern: re.search(pattern, intent.text) is not None
    no = F.lit(False)
    found = F.col("_sizes")
    titled = F.when(title.rlike(r"\b(refurbished|renewed|remanufactured)\b"), "refurbished").when(title.rlike(r"\b(used|pre owned|b grade|c grade|grade [bc])\b"), "used")
    condition = F.coalesce(titled, "condition", F.lit("unknown"))
    with_extras = (F.col("category") == "phone") & (title != subject) & subject.rlike(PHONE_FIRST) & subject.rlike(r"\b\d+(?:gb|tb)\b") & ~subject.rlike(PHONE_PART)
    accessory = F.when(with_extras, _names_accessory(F.split(subject, " "), subject)).otherwise(_names_accessory(words, F.col("_said")))
    if intent.kind:
        accessory = accessory & (F.col("_kind") != "console")
    series = intent.category == "watch" and asked(SERIES_ASKED)
    if series:
        accessory = accessory & ~_whole_watch()
    out = {
        "kind": F.col("category") != intent.category if intent.category else F.col("_kind") != intent.kind if intent.kind else no,
        "accessory": no if intent.accessory else accessory,
        "capacity": (F.size(found) > 0) & ~F.array_contains(found, intent.storage) if intent.storage else no,
        "condition": (condition != "unknown") & (condition != (intent.condition or "new")),
        "carrier": no if intent.carrier else (F.col("category") == "phone") & F.col("title").rlike(CARRIERS),
    }
    unasked = [w for w in VARIANT_WORDS if w not in intent.variants]
    out["variant"] = any_of(unasked) & ~F.col("category").eqNullSafe("shoes") if intent.model else no
    out["model"] = F.exists("_named", lambda m: m != intent.model) if intent.model else no
    out["principal"] = _only_a_part(intent)
    laptop = F.col("category") == "laptop"
    memory = F.col("_memory")
    out["ram"] = laptop & (memory != intent.ram) if intent.ram else no
    out["ram_unverified"] = laptop & memory.isNull() if intent.ram else no
    sparse = (F.size(F.split(title, " ")) <= 4) & ~any_of(LAPTOP_LINES) & ~any_of(LAPTOP_PARTS) & ~title.rlike(r"\d+(?:gb|tb)\b")
    out["sparse"] = laptop & sparse if intent.category == "laptop" else no
    audio = intent.category == "audio"
    out["subject"] = title.rlike(SPEAKERS) & ~title.rlike(HEADPHONES) if audio and asked(HEADPHONES) and not asked(SPEAKERS) else no
    unproven = [~c for c in _proofs(intent).values()]
    if series:
        unproven.append(~_whole_watch())
    if audio and asked(SPEAKERS) and not asked(HEADPHONES):
        unproven.append(~subject.rlike(SPEAKER_SOLD))
    if intent.model and re.fullmatch(r"dyson v\d+", intent.model):
        unproven.append(~title.rlike(rf"\b{intent.model}\b"))
    out["unproven"] = F.greatest(no, *[F.coalesce(c, F.lit(True)) for c in unproven]) if unproven else no
    return {k: F.coalesce(c, no) for k, c in out.items()}


def _hits(intent: Intent) -> Column:
    words = F.col("_words")
    if intent.ram:
        words = F.when(F.col("_memory") == intent.ram, F.concat(words, F.array(F.lit(str(intent.ram)), F.lit(f"{intent.ram}gb")))).otherwise(words)
    for word, proof in _proofs(intent).items():
        words = F.when(proof, F.concat(words, F.array(F.lit(word)))).otherwise(F.array_remove(words, word))
    return F.size(F.array_intersect(F.array(*[F.lit(t) for t in intent.tokens]), words)) if intent.tokens else F.lit(0)


def _score(intent: Intent, hits: Column, bad: dict[str, Column]) -> Column:
    """The match score, from 0 to 1 with two decimals; 0 if the query or the offer says nothing."""
    n = len(intent.tokens)
    if not intent.text:
        return F.lit(0.0)
    base = hits / F.lit(float(n)) if n else F.lit(1.0)
    if intent.category:
        base = F.when(bad["kind"], base * LEFT_BY["kind"]).otherwise(F.least(F.lit(1.0), (hits + 1) / F.lit(n + 1.0)) if n else F.lit(1.0))
    elif intent.kind:
        base = F.when(bad["kind"], base * LEFT_BY["kind"]).otherwise(base)
    left = lambda name, flag: F.when(bad[flag], LEFT_BY[name]).otherwise(1.0)
    base = base * left("subject", "subject") * left("principal", "principal") * left("accessory", "accessory")
    if intent.mode == "brand" and not intent.category:
        own = BRAND_CATEGORIES[intent.brand]
        lifted = [F.when(F.col("category") == c, F.least(F.lit(1.0), base + max(BRAND_LEAST, BRAND_LIFT - i * BRAND_STEP))) for i, c in enumerate(own)]
        base = F.coalesce(*lifted, F.when(F.col("category").isNotNull(), base * OTHER_CATEGORY), base)
    base = base * left("variant", "capacity") * left("variant", "variant") * left("model", "model") * left("carrier", "carrier")
    base = base - F.when(bad["condition"], CONDITION_COST).otherwise(0.0)
    base = F.when(bad["sparse"], F.least(base, F.lit(DOUBTFUL))).otherwise(base) * left("ram", "ram")
    base = F.when(bad["ram_unverified"] | bad["unproven"], F.least(base, F.lit(DOUBTFUL))).otherwise(base)
    return F.when(F.col("_said") == "", 0.0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)) * 100 + 0.5) / 100)


_READ = ["_title", "_said", "_sold", "_words", "_named", "_sizes", "_memory", "_kind", "_hit"]


def _assessed(offers: DataFrame, intent: Intent) -> tuple[DataFrame, dict[str, Column]]:
    """The assessed offers with what was read of them and their flags, and the flags by name."""
    flags = _flags(intent)
    rows = _read(offers, intent).withColumns({**{f"_bad_{k}": c for k, c in flags.items()}, "_hit": _hits(intent)})
    bad = {k: F.col(f"_bad_{k}") for k in flags}
    rows = rows.withColumns({"query_score": _score(intent, F.col("_hit"), bad), "all_hits": F.col("_hit") == len(intent.tokens)})
    clean = ~F.greatest(*[c for k, c in bad.items() if k != "sparse"])
    return rows.withColumn("exact", (F.col("query_score") >= EXACT) & F.col("all_hits") & clean), bad


def assess(offers: DataFrame, intent: Intent) -> DataFrame:
    """Adds query_score, all_hits and exact: nothing an offer once scored for another query is used."""
    out, bad = _assessed(offers, intent)
    return out.drop(*_READ, *[f"_bad_{k}" for k in bad])


def reasons(offers: DataFrame, intent: Intent) -> DataFrame:
    """Adds why an offer isn't what was asked for: model_conflict, capacity_conflict, query_mismatch; empty for those to keep."""
    out, bad = _assessed(offers, intent)
    missing = ~F.array_contains("_named", intent.model) if intent.model else F.lit(False)
    mismatch = (~F.col("exact") if intent.storage or intent.model else F.col("query_score") < 0.65) | missing
    said = [F.when(bad["model"], "model_conflict"), F.when(bad["capacity"], "capacity_conflict"), F.when(mismatch, "query_mismatch")]
    return out.withColumn("reasons", F.array_join(F.array_compact(F.array(*said)), ",")).drop(*_READ, *[f"_bad_{k}" for k in bad])


def admitted(intent: Intent) -> Column:
    """Whether an assessed offer has a fair score, or two of the query's words in the title (one, if it has just one)."""
    wanted = [t for t in dict.fromkeys(intent.text.split()) if len(t) > 1 and t not in STOP_WORDS]
    hits = F.size(F.array_intersect(tokens(F.col("title")), F.array(*[F.lit(t) for t in wanted]))) if wanted else F.lit(0)
    return (F.col("query_score") >= FLOOR) | ((F.lit(len(wanted)) > 0) & (hits >= (1 if len(wanted) == 1 else 2)))


#: what an offer's path is read from, whatever its host and parameters
_PATH = r"^https?://[^/?#]+(/[^?#]*)"


def by_text(offers: DataFrame, intent: Intent, add: Callable[[DataFrame, Intent], DataFrame]) -> DataFrame:
    """`add(offers, intent)`, one of the functions above, worked out once for each text that offers share and joined back to them.

    The texts are all that is read of an offer: title, brand, category, condition and the address's path; for consoles and games also the
    storage, the model number and the whole address. Reading costs far more than the join. `add` adds columns and keeps all rows.
    """
    names = ("title", "brand", "category", "condition", *(("storage", "model_number", "source_url") if intent.kind else ()))
    read = {c: F.col(c) for c in names if c in offers.columns}
    if "source_url" in offers.columns and not intent.kind:
        read["source_url"] = F.concat(F.lit("https://x"), F.regexp_extract("source_url", _PATH, 1))
    made = add(offers.select(*[c.alias(n) for n, c in read.items()]).distinct(), intent)
    new = [c for c in made.columns if c not in read]

    def keys(columns: list[Column]) -> dict[str, Column]:
        absent = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
        return {"_said": F.xxhash64(absent, *columns), "_check": F.xxhash64(F.lit("check"), absent, *columns)}

    # exploded, so that a filter on a result isn't moved below it, where each mention of a column works out all that is behind it again
    found = made.withColumns(keys([F.col(c) for c in read])).select("_said", "_check", F.explode(F.array(F.struct(*new))).alias("_made")).select("_said", "_check", "_made.*")
    return offers.drop(*new).withColumns(keys(list(read.values()))).join(found, ["_said", "_check"]).drop("_said", "_check")


def _admission(offers: DataFrame, intent: Intent) -> DataFrame:
    return assess(offers, intent).withColumn("_admitted", admitted(intent))


def admit(offers: DataFrame, intent: Intent) -> DataFrame:
    return by_text(offers, intent, _admission).where("_admitted").drop("_admitted")


def retain_acquired(offers: DataFrame, intent: Intent) -> DataFrame:
    """Offers of a source to keep: those that fit, and for a query with a model also admissible ones that contradict neither model nor capacity."""

    def kept(rows: DataFrame, intent: Intent) -> DataFrame:
        fits = F.col("reasons") == ""
        if intent.model:
            fits = fits | (~F.col("reasons").rlike("model_conflict|capacity_conflict") & admitted(intent))
        return reasons(rows, intent).withColumn("_kept", fits)

    return by_text(offers, intent, kept).where("_kept").drop("_kept")


def retain_related(offers: DataFrame, intent: Intent, identity: list[str]) -> DataFrame:
    """The newest offer of each identity, scored and admitted; in order of score (a sort over ranges, of what is left)."""
    scored = by_text(offers, intent, _admission)
    return newest(scored, identity, ["offer_id"]).where("_admitted").drop("_admitted").orderBy(F.desc("query_score"), F.col("product_price").asc_nulls_last(), "offer_id")


def simple_score(query: str, text: Column) -> Column:
    """The share of the query's words that occur anywhere in the text, even inside words."""
    words = re.sub(r"[^\w]+|_", " ", query.lower()).split()
    if not words:
        return F.lit(0.0)
    plain = plain_text(text)
    return sum((F.when(plain.contains(w), 1).otherwise(0) for w in words), F.lit(0)) / F.lit(float(len(words)))
