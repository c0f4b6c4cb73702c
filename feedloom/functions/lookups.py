"""Names, aliases, limits and unit factors that results depend on."""

# Header keys of each input field.
HEADER_ALIASES = {
    "mfg_part_num": ["mfgpartnum", "mfgrpartnum", "manufacturerpartnumber", "manufacturerpartno", "manufacturerpartnum", "manufpartnum", "mpn", "partnumber", "partno", "pn", "partnum", "mfrpartnumber", "mfgpartno", "catalognumber", "itemnumber", "skupart"],
    "manufacturer_name": ["manufacturer", "manufacturermfr", "mfr", "mfg", "mfrname", "mfgname", "manufacturername", "manufname", "vendormanufacturer", "maker", "partmanuf"],
    "brand_name": ["brand", "brandname"],
    "trade_name": ["tradename"],
    "sku": ["sku", "skucode", "internalsku"],
    "alternate_part_number": ["alternatepartnumber", "altmpn", "alternatempn", "altpartnumber", "substitutepartnumber", "equivpartnumber"],
    "product_name": ["productname", "itemname"],
    "dept": ["dept", "department"],
    "class": ["class", "subclass"],
    "fine": ["fine", "finetaxonomy"],
    "classpath": ["classpath", "categorypath", "taxonomy", "hierarchy", "category", "producttype", "productcategory", "commodity"],
    "part_desc": ["partdesc", "description", "desc", "productdescription", "itemdescription", "longdescription", "shortdescription", "title"],
    "invoice_desc": ["invoicedesc", "invoicedescription"],
    "mobile_desc": ["mobiledesc", "mobiledescription"],
    "short_desc": ["shortdesc2", "shortdescription2"],
    "long_desc1": ["longdesc1", "longdescription1"],
    "retail_desc": ["retaildesc", "retaildescription"],
    "marketing_description": ["marketingdescription", "marketing"],
    "upc": ["upc", "upccode", "upca"],
    "ean": ["ean", "eancode", "ean13"],
    "gtin": ["gtin", "gtincode", "gtin13", "gtin14", "gtin8"],
    "unspsc": ["unspsc", "unspsccode", "commoditycode"],
    "list_price": ["listprice", "price", "msrp", "unitprice"],
    "length": ["length", "len"],
    "width": ["width", "wd"],
    "height": ["height", "ht"],
    "weight": ["weight", "netweight", "shippingweight", "grossweight", "wt"],
    "country_of_origin": ["countryoforigin", "origin", "country", "countryofmanufacture", "coo"],
    "warranty": ["warranty", "warrantytinformation", "warrantyterms"],
    "selling_qty": ["sellingqty", "packquantity", "qtyperpack", "unitsperpack"],
    "standards_approvals": ["standardsapprovals", "standardapprovals", "certifications", "certification", "approvals"],
    "prop_65": ["prop65", "proposition65", "prop65warning"],
    "application": ["application", "applications", "usecase", "suitablefor"],
    "includes": ["includes", "includeditems", "whatsincluded", "kitcontents"],
}
AMBIGUOUS_HEADERS = ["model", "part", "size", "type", "code", "name", "value", "unit", "uom"]
MEASURES = ["length", "width", "height", "weight"]
NUMERIC_FIELDS = ["list_price", "length", "width", "height", "weight", "selling_qty"]
BARCODE_FIELDS = ["upc", "ean", "gtin"]

# Cells that stand for no value (lower case), the three brands among them.
PLACEHOLDER_BRANDS = ["-- unbranded --", "-- no unilog brand --", "-- no dib brand --"]
# Cells of an upload that stand for no value, as they are written.
UPLOAD_PLACEHOLDERS = ["-- Unbranded --", "-- No Unilog Brand --", "-- No DIB Brand --"]
PLACEHOLDERS = PLACEHOLDER_BRANDS + ["-", "--", "---", "n/a", "na", "n.a.", "none", "null", "nil", "tbd", "not applicable", "notavailable", "unknown", "", "#n/a", "#na"]

# Company suffixes left out of name keys.
NAME_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "gmbh", "co", "corp", "corporation", "company", "ag", "bv", "plc", "kg", "ug"]

# Attribute labels of one meaning, and the attributes that matter in known categories.
SYNONYMS = {
    "voltage": "voltage",
    "voltage rating": "voltage",
    "voltage (v)": "voltage",
    "power": "power_rating",
    "power rating": "power_rating",
    "horsepower": "power_rating",
    "current": "current",
    "current (a)": "current",
    "amperage": "current",
    "resistance": "resistance",
    "temp": "temperature",
    "temperature rating": "temperature",
    "temp rating": "temperature",
}
RELEVANT = {
    "industrial": ["voltage", "current", "power_rating", "resistance", "temperature", "frequency", "phase", "horsepower", "rpm", "efficiency", "protection_rating", "material", "dimensions", "weight", "mounting_type"],
    "electronics": ["voltage", "current", "power_rating", "frequency", "phase", "temperature", "capacitance", "inductance", "resistance", "efficiency", "connection_type", "housing_material", "dimensions", "weight"],
    "automotive": ["voltage", "current", "power_rating", "resistance", "temperature", "frequency", "phase", "mounting_type", "connector_type", "material", "dimensions", "weight", "ip_rating"],
    "construction": ["dimensions", "weight", "material", "load_capacity", "temperature", "corrosion_rating", "certification", "mounting_type"],
    "consumer": ["voltage", "current", "power_rating", "frequency", "dimensions", "weight", "material", "connection_type"],
    "medical": ["voltage", "current", "power_rating", "dimensions", "weight", "material", "sterilization_compatible", "regulatory_approval"],
}
FAKE_VALUE = r"^(--|n/a|not.applicable|tbd|pending|unknown|na|null|no information|to be determined)$"

# Asset types by lower-case name; anything else is a reference_url.
ASSET_TYPES = {
    "product_image": "product_image",
    "spec_sheet": "specification_sheet",
    "manual": "instruction_manual",
    "mfr_url": "manufacturer_url",
    "ref_url": "reference_url",
    "sds": "SDS",
    "warranty_information": "warranty_information",
    "catalog": "catalog",
    "specification_sheet": "specification_sheet",
    "instruction_manual": "instruction_manual",
    "service_manual": "service_manual",
    "owners_manual": "owners_manual",
    "line_drawing": "line_drawing",
    "mtr": "MTR",
    "rohs": "RoHS",
    "engineering_drawing": "engineering_drawing",
    "energy_star_guide": "energy_star_guide",
    "technical_bulletin": "technical_bulletin",
    "submittal": "submittal",
    "compatibility_chart": "compatibility_chart",
    "size_chart": "size_chart",
    "product_label": "product_label",
    "video": "video",
} | {f"image_{i}": "alternate_image" for i in range(1, 6)}

# Domains by kind of source, and the order of their authority.
SOURCE_DOMAINS = {
    "manufacturer": ["milwaukeetool.com", "dewalt.com", "boschtools.com", "makitatools.com", "metabo.com", "hilti.com", "3m.com", "stanleyblackanddecker.com"],
    "distributor": ["grainger.com", "mcmaster.com", "zoro.com", "digikey.com", "mouser.com", "newark.com", "frys.com"],
    "secondary": ["wikipedia.org", "ansi.org", "iso.org", "astm.org", "ul.com", "osha.gov"],
}
SOURCE_TIERS = {"manufacturer": 1, "distributor": 2, "secondary": 3, "unknown": 4}
AUTHORITY = {"external": 3, "input": 2, "inferred": 1}

# Words that mark a sentence about a product.
PRODUCT_WORDS = ["manufacturer", "brand", "mpn", "part number", "model", "upc", "ean", "gtin", "sku", "weight", "dimension", "length", "width", "height", "depth", "warranty", "voltage", "current", "wattage", "power", "amperage", "rpm", "temperature", "pressure", "psi", "capacity", "material", "finish", "color", "pack", "quantity", "application", "specification", "features", "description"]

# Fields found in page text: pattern (value in group 1, unit in group 2), whether it has a unit, confidence.
_NUMBER, _LENGTH = r"([0-9]+(?:\.[0-9]+)?)", r"(mm|millimeter|cm|centimeter|m|meter|in|inch(?:es)?|ft|feet)\b\.?"
EVIDENCE_PATTERNS = {
    "upc": (r"\bUPC\b\s*[:#]?\s*([0-9]{6,14})\b", False, 0.98),
    "ean": (r"\bEAN\b\s*[:#]?\s*([0-9]{8,13})\b", False, 0.97),
    "gtin": (r"\bGTIN(?:-\d+)?\b\s*[:#]?\s*([0-9]{8,14})\b", False, 0.96),
    "weight": (rf"\b(?:Weight|Shipping Weight|Net Weight)\b\s*[:#]?\s*{_NUMBER}\s*(kg|kilogram|g|gram|lbs?|lb|pound|oz|ounce)\b\.?", True, 0.92),
    "length": (rf"\bLength\b\s*[:#]?\s*{_NUMBER}\s*{_LENGTH}", True, 0.90),
    "width": (rf"\bWidth\b\s*[:#]?\s*{_NUMBER}\s*{_LENGTH}", True, 0.90),
    "height": (rf"\bHeight\b\s*[:#]?\s*{_NUMBER}\s*{_LENGTH}", True, 0.90),
    "depth": (rf"\bDepth\b\s*[:#]?\s*{_NUMBER}\s*{_LENGTH}", True, 0.88),
    "warranty": (r"\bWarranty\b\s*[:#]?\s*([^.]{2,80}?)(?:\.|$)", False, 0.88),
    "voltage": (rf"\bVoltage(?:\s*Rating)?\b\s*[:#]?\s*{_NUMBER}\s*(V|Volts?|mV|kV)\b\.?", True, 0.93),
    "current": (rf"\b(?:Current|Amperage|Amps?)\b\s*[:#]?\s*{_NUMBER}\s*(A|Amps?|Amperes?|mA)\b\.?", True, 0.92),
    "power": (rf"\b(?:Power|Wattage)\b\s*[:#]?\s*{_NUMBER}\s*(W|Watts?|kW)\b\.?", True, 0.92),
    "rpm": (r"\b(?:Max\s*)?RPM\b\s*[:#]?\s*([0-9][0-9,]*)\b", False, 0.90),
    "pressure": (rf"\bPressure\b\s*[:#]?\s*{_NUMBER}\s*(psi|PSI|bar|kPa|Pa)\b\.?", True, 0.90),
    "temperature": (r"\bTemperature(?:\s*Range|\s*Rating)?\b\s*[:#]?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(°?C|°?F|Celsius|Fahrenheit)\b\.?", True, 0.90),
    "pack_quantity": (r"\bPack(?:\s*of|\s*Quantity|\s*Size)?\s*[:#]?\s*([0-9]{1,3})\b", False, 0.85),
}
#: Words in lower case of which one is part of every match of a field's pattern.
EVIDENCE_WORDS = {f: [f] for f in EVIDENCE_PATTERNS} | {"current": ["current", "amp"], "power": ["power", "wattage"], "pack_quantity": ["pack"]}
UNITS = {
    **dict.fromkeys(["kg", "kilogram", "kilograms"], "kg"),
    **dict.fromkeys(["g", "gram", "grams"], "g"),
    **dict.fromkeys(["lb", "lbs", "pound", "pounds"], "lb"),
    **dict.fromkeys(["oz", "ounce", "ounces"], "oz"),
    **dict.fromkeys(["mm", "millimeter", "millimeters"], "mm"),
    **dict.fromkeys(["cm", "centimeter", "centimeters"], "cm"),
    **dict.fromkeys(["m", "meter", "meters"], "m"),
    **dict.fromkeys(["in", "inch", "inches"], "in"),
    **dict.fromkeys(["ft", "feet"], "ft"),
    **dict.fromkeys(["v", "volt", "volts"], "V"),
    **dict.fromkeys(["a", "amp", "amps", "amperes"], "A"),
    **dict.fromkeys(["w", "watt", "watts"], "W"),
    **dict.fromkeys(["c", "celsius"], "C"),
    **dict.fromkeys(["f", "fahrenheit"], "F"),
    **{"mv": "mV", "kv": "kV", "ma": "mA", "kw": "kW", "psi": "psi", "bar": "bar", "kpa": "kPa", "pa": "Pa"},
}
TO_KG = {"kg": 1.0, "g": 0.001, "lb": 0.45359237, "oz": 0.028349523125}
TO_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "ft": 304.8}

# Longest descriptions, steps of an enrichment run, and item states with their display names.
MAX_LENGTHS = {"invoice_desc": 40, "mobile_desc": 80, "short_desc": 180, "long_desc1": 500, "marketing_description": 350, "retail_desc": 200}
DEFAULT_LENGTH = 500
STEPS = ["manufacturer", "classify", "external_evidence", "attributes", "descriptions", "specs"]
STATUSES = ["raw", "enriching", "enriched", "review", "failed"]
CRITICAL_FIELDS = ["manufacturer_name", "brand_name", "classpath"]

# Reasons given for the fields that a product lacks or has.
RATIONALE = {
    "mpn_anchored": "MPN missing but manufacturer + strong description/category exists",
    "mpn_alone": "MPN missing without sufficient identity anchors - leave unresolved",
    "code": " missing - will attempt external retrieval if evidence available",
    "weight": "weight missing - common field, worth external lookup",
    "warranty": "warranty missing - critical field, always prioritize",
    "dimensions": "dimensions missing - common for products",
    "present": " already present",
    "voltage": "Voltage Rating - electronics category",
    "horsepower": "Horsepower/RPM - industrial category",
}

# Hosts and address ranges that are never fetched, elements that hold no page text, and how a page names its part number.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "::1", "metadata.google.internal", "metadata.oraclecloud.com", "metadata", "instance-data"]
BLOCKED_IP = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[0-1])\.|169\.254\.|0\.|127\.|100\.100\.100\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2(4|5)[0-9]\.)"
# Elements of raw text, without content, and whose text is no text of the page; and how much an end tag may close (100 where not named).
RAW_TAGS = ["script", "style"]
VOID_TAGS = ["area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "isindex", "link", "meta", "param"]
SILENT_TAGS = ["template", "rt", "rp"]
END_PRIORITY = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
DROPPED_TAGS = ["script", "style", "noscript", "iframe", "svg", "nav", "form", "footer", "header", "aside"]
NAMED_MPN = r"(?:mpn|part\s*number|manufacturer\s*part\s*number|model)\s*[:#]?\s*([\p{L}\p{N}][\p{L}\p{N}_\-/.]{2,30})"
