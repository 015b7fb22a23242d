"""Word lists, phrase lists and patterns that the scores are defined by."""

from __future__ import annotations

# Slang, by script.
RU_SLANG = ["имба", "имбовый", "топчик", "кайф", "кринж", "жиза", "рофл", "лол", "угар", "нормас", "огонь", "пушка", "бомба", "зашло", "залип", "четко", "четкий", "мощно", "прикольно", "улет"]
TRANSLIT_SLANG = ["imba", "topchik", "kayf", "krinzh", "zhiza", "rofl", "normas", "ogon", "pushka", "chetko", "zashlo"]
EN_SLANG = ["bro", "bruh", "fr", "ngl", "lowkey", "highkey", "legit", "solid", "fire", "lit", "dope", "goated", "sus", "vibe", "vibes", "clutch", "banger", "slaps", "mid", "cap", "clean"]
SLANG_PHRASES = ["прям кайф", "вообще топ", "чисто кайф", "на изи", "без базара", "no cap", "for real", "straight fire", "big vibe", "super legit"]
PROMO_PHRASES = ["надо брать", "берите не пожалеете", "топ за свои деньги", "всем советую", "просто пушка", "реально имба", "чистый кайф", "must cop", "go buy it", "10/10 recommend", "worth it fr", "instant cop", "bestie approved", "you need this"]
DETAIL = [
    "size", "fit", "color", "material", "delivery", "package", "packaging", "quality", "weight", "smell", "taste", "texture", "battery", "screen", "charge", "button", "comfort", "refund", "seller", "return",
    "размер", "посадка", "цвет", "материал", "доставка", "упаковка", "качество", "вес", "запах", "вкус", "фактура", "батарея", "экран", "заряд", "кнопка", "удобно", "возврат", "продавец",
]

# Keywords that tell a product domain, and the domain's words of detail; the first of equal domains wins.
DOMAIN_KEYWORDS = {
    "apparel": ["shoe", "shoes", "sneaker", "sneakers", "sandals", "shirt", "dress", "jacket", "hoodie", "sock", "sole", "heel", "fabric", "insole", "обувь", "кроссовки", "сандалии", "футболка", "куртка", "подошва", "стелька", "ткань"],
    "electronics": ["phone", "smartphone", "laptop", "tablet", "charger", "charging", "battery", "screen", "camera", "sensor", "headphones", "keyboard", "mouse", "headset", "power", "bank", "lamp", "телефон", "ноутбук", "планшет", "зарядка", "батарея", "экран", "камера", "наушники", "мышь", "гарнитура", "лампа"],
    "beauty": ["cream", "serum", "lotion", "mascara", "lipstick", "skin", "shade", "scent", "fragrance", "крем", "сыворотка", "тушь", "помада", "кожа", "оттенок", "аромат"],
    "food": ["coffee", "tea", "snack", "protein", "sauce", "flavor", "taste", "sweet", "salty", "recipe", "dish", "кофе", "чай", "вкус", "аромат", "сладкий", "соленый", "соус", "рецепт", "блюдо"],
    "home": ["chair", "table", "lamp", "pillow", "blanket", "shelf", "assembly", "wood", "vacuum", "cleaner", "blender", "jar", "стул", "стол", "лампа", "подушка", "плед", "полка", "сборка", "дерево", "пылесос", "блендер"],
}
DOMAIN_DETAIL = {
    "apparel": ["size", "fit", "fabric", "sole", "heel", "insole", "stitching", "waist", "sleeve", "collar", "размер", "посадка", "шов", "подошва", "стелька", "ткань"],
    "electronics": ["battery", "screen", "charge", "charging", "cable", "camera", "speaker", "mic", "latency", "firmware", "display", "scroll", "cursor", "заряд", "зарядка", "кабель", "камера", "микрофон", "звук", "экран", "мышь", "курсор"],
    "beauty": ["shade", "texture", "scent", "finish", "coverage", "hydration", "skin", "оттенок", "фактура", "аромат", "финиш", "кожа", "увлажнение"],
    "food": ["taste", "flavor", "aftertaste", "aroma", "sweet", "salty", "crunchy", "recipe", "вкус", "послевкусие", "аромат", "сладкий", "соленый", "хрустящий", "рецепт"],
    "home": ["assembly", "wood", "screw", "fabric", "foam", "stability", "bin", "brush", "jar", "lid", "сборка", "дерево", "винт", "ткань", "пена", "устойчивость", "контейнер", "щетка", "крышка"],
}

# Marketplace packs, by aliases looked for in the source's token; the first that fits wins.
PACK_ALIASES = {
    "amazon": ["amazon", "prime", "fba"],
    "wildberries": ["wildberries", "wildberry", "wb", "wilda"],
    "ozon": ["ozon", "ozon_ru", "ozonru", "ozonchik"],
    "yandex_market": ["yandex_market", "yandexmarket", "market_yandex", "ymarket", "market"],
    "aliexpress": ["aliexpress", "ali", "aliexpresscom", "aliexpress_ru", "alik"],
}
PACK_DETAIL = {
    "amazon": ["prime", "seller", "listing", "warehouse", "refund", "return", "shipping", "delivery window", "packaged"],
    "wildberries": ["wb", "wildberries", "pvz", "seller", "return", "package", "pickup point", "пвз", "продавец", "возврат", "пункт выдачи"],
    "ozon": ["ozon", "seller", "courier", "pickup point", "parcel", "refund", "пвз", "курьер", "продавец", "озон", "возврат"],
    "yandex_market": ["market", "yandex", "split", "seller", "delivery slot", "refund", "маркет", "яндекс", "сплит", "продавец", "возврат"],
    "aliexpress": ["ali", "seller", "tracking", "parcel", "customs", "refund", "али", "трек", "продавец", "посылка", "таможня", "спор"],
}
PACK_SLANG = {"amazon": ["prime", "unbox", "dupe"], "wildberries": ["wb", "wilda", "вайлд", "вайлдберриз"], "ozon": ["ozon", "ozonchik", "озончик"], "yandex_market": ["ym", "ymarket", "маркет"], "aliexpress": ["ali", "alik", "али", "алик"]}
PACK_AUTHENTIC = {"amazon": ["seller", "refund", "arrived", "boxed"], "wildberries": ["пвз", "возврат", "примерка", "pickup"], "ozon": ["курьер", "пвз", "parcel", "refund"], "yandex_market": ["split", "refund", "delivery slot", "маркет"], "aliexpress": ["tracking", "parcel", "спор", "refund"]}
PACK_PROMO = {
    "amazon": ["amazon find", "prime worthy", "worth the prime shipping"], "wildberries": ["на wb топ", "wb must have", "разобрали на wb"], "ozon": ["ozon must buy", "на ozon забрала сразу", "ozon top find"],
    "yandex_market": ["маркет топ", "best market deal", "яндекс маркет топ"], "aliexpress": ["ali steal", "must grab on ali", "али топ за свои деньги"],
}

# Words too common for a learned lexicon.
STOPWORDS = ["the", "and", "for", "with", "that", "this", "was", "are", "but", "not", "very", "just", "from", "have", "has", "had", "will", "your", "you", "they", "them", "their", "our", "its", "it", "есть", "это", "как", "для", "что", "все", "тоже", "если", "когда", "просто", "очень", "было", "были", "мне", "меня", "своих", "свои", "еще", "тут", "там"]

# Promotional phrases of ratings and of review pages, looked for as substrings.
RATING_PHRASES = ["buy now", "100% recommended", "best service ever", "best purchase ever", "must buy", "trust me", "perfect product", "perfect service", "changed my life", "highly recommended", "worth it fr", "instant cop", "you need this"]
PAGE_PHRASES = ["buy now", "100% recommended", "best purchase ever", "must buy", "trust me", "perfect product", "changed my life", "highly recommended"]

# What a blocked page says.
BLOCKED = ["access denied", "are you a robot", "captcha", "checking your browser", "enable javascript and cookies", "robot check", "unusual traffic", "verify you are human"]

# Phrases of machine-written and of personal review text.
GENERIC = ["overall", "in conclusion", "to summarize", "it is worth noting", "as a user", "this product delivers", "pleasantly surprised", "exceeded my expectations", "highly recommend", "recommend it to anyone", "great value for money", "perfect choice", "в целом", "следует отметить", "можно сказать", "данный товар", "данное устройство", "покупка оправдала", "подводя итог", "рекомендую к покупке", "приятно удивил", "превзошел ожидания"]
CONNECTORS = ["however", "moreover", "furthermore", "additionally", "therefore", "nevertheless", "on the other hand", "однако", "кроме того", "тем не менее", "при этом", "с другой стороны"]
CATALOG = ["excellent quality", "premium quality", "durable materials", "modern design", "user-friendly", "reliable performance", "high quality", "stylish appearance", "отличное качество", "высокое качество", "качественные материалы", "стильный дизайн", "удобен в использовании", "надежная работа"]
CLICHES = ["price is fair", "worth paying", "worth the money", "shipping/support/packaging", "delivery/support/packaging", "pleasantly surprised", "цена адекватная", "не жалко платить", "платить за результат", "доставка/поддержка/упаковка", "доставка поддержка упаковка", "приятно удивили", "приятно удивила"]
STRUCTURE_MARKERS = ["достоинства:", "недостатки:", "комментарий:", "pros:", "cons:"]
STRUCTURE_TERMS = ["оригинал", "пломб", "серийн", "гарант", "подделк", "упаков", "короб", "достав", "прошивк", "заряд", "звук", "айфон", "макбук", "размер", "детал", "ребен", "ребён"]
PERSONAL = [
    "i bought", "i use", "my wife", "my husband", "my kid", "my desk", "at work", "in the kitchen", "after a week", "after two weeks", "delivered", "box arrived", "charging", "battery", "scratched", "size", "cm", "mm",
    "брал", "брала", "заказал", "заказала", "пользуюсь", "доставили", "через неделю", "на кухне", "на работе", "ребенку", "мужу", "жене", "размер", "упаковк", "царап", "заряд",
]
COLLOQUIAL = ["ok", "meh", "kinda", "pretty good", "not bad", "works fine", "for the price", "норм", "нормально", "так себе", "за свои деньги", "пока норм", "вроде", "коробка"]

# Patterns of marketing text on photos, in any script.
PHOTO_PATTERNS = {
    "sale_discount": [r"\bsale\b", r"\bdiscount\b", r"\bcoupon\b", r"\bpromo\b", r"\b\d{1,2}\s?%\s?off\b", r"\bfree shipping\b", r"\bclearance\b", r"\bскидк", r"\bакци", r"\bраспродаж", r"\bпромо"],
    "hype_claim": [r"\bbest product\b", r"\bbest seller\b", r"\btop choice\b", r"\bmust buy\b", r"\b#\s?1\b", r"\bnumber one\b", r"\bхит продаж\b", r"\bлучший товар\b", r"\bтоп товар\b"],
    "watermark_marker": [r"\bwatermark\b", r"\bofficial store\b", r"\bsponsored\b", r"\badvertisement\b", r"\bреклама\b", r"\bофициальный магазин\b"],
    "contact_or_store": [r"\bwhatsapp\b", r"\btelegram\b", r"\binstagram\b", r"\btiktok\b", r"\bvk\b", "@[a-z0-9_.-]{3,}", r"\b[a-z0-9-]+\.(com|ru|net|shop|store)\b"],
}
#: What a match of those patterns that are more than plain words holds at least.
PHOTO_NEEDED = {r"\b\d{1,2}\s?%\s?off\b": ["off"], r"\b#\s?1\b": ["#"], "@[a-z0-9_.-]{3,}": ["@"], r"\b[a-z0-9-]+\.(com|ru|net|shop|store)\b": [".com", ".ru", ".net", ".shop", ".store"]}
PHOTO_WEIGHTS = {"sale_discount": 0.18, "hype_claim": 0.18, "watermark_marker": 0.20, "contact_or_store": 0.18, "marketplace_text": 0.16, "foreign_marketplace_watermark": 0.32}
PHOTO_MARKETS = {
    "amazon": ["amazon", "amzn"], "aliexpress": ["aliexpress", "ali express"], "temu": ["temu"], "shein": ["shein"], "ozon": ["ozon", "озон"], "wildberries": ["wildberries", "wb", "вб", "вайлдберриз"], "walmart": ["walmart"],
    "ebay": ["ebay"], "etsy": ["etsy"], "yandex_market": ["yandex market", "яндекс маркет", "market.yandex"], "lamoda": ["lamoda", "ламода"], "kaspi": ["kaspi", "каспи"], "flipkart": ["flipkart"], "allegro": ["allegro"],
}

# Hints in image URLs.
STOCK_HINTS = ["ad", "advert", "banner", "catalog", "hero", "listing", "marketing", "mockup", "packshot", "promo", "product-image", "render", "studio", "white-bg", "white-background"]
STRONG_STOCK_HINTS = ["banner", "catalog", "hero", "marketing", "mockup", "packshot", "promo", "render", "studio"]
CUSTOMER_HINTS = ["buyer", "cr-media", "customer", "photo-review", "review", "reviews", "ugc", "user"]
SYNTHETIC_HINTS = ["ai-generated", "aigenerated", "automatic1111", "comfyui", "dall-e", "dalle", "diffusion", "generated", "midjourney", "sdxl", "stable-diffusion", "stablediffusion", "synthetic", "text-to-image"]
STRONG_SYNTHETIC_HINTS = ["ai-generated", "aigenerated", "automatic1111", "comfyui", "dall-e", "dalle", "midjourney", "sdxl", "stable-diffusion", "stablediffusion", "synthetic", "text-to-image"]

# Words of marketplace reviews that carry little risk; their markers are STRUCTURE_MARKERS.
LOW_RISK_TERMS = ["оригинал", "качество", "хорош", "отлич", "супер", "понрав", "восторг", "счастлив", "красот", "упаков", "короб", "ребен", "ребён", "дети", "детал", "набор", "лего", "игра", "собрал", "подар", "ярк", "размер", "достав", "пломб", "серийн", "гарант", "звук", "подош", "работает", "удоб", "заряд", "покуп"]

# Product families by phrases in the source's name, then in the text; the first that fits wins.
FAMILY_SOURCES = {"food_recipe": ["recipe", "food", "cooking"], "travel": ["travel"], "local_business": ["yelp", "restaurant", "business"], "beauty": ["beauty"]}
FAMILY_TEXTS = {
    "wireless_mouse": ["wireless mouse", "mouse pad", "scroll wheel", "cursor", "pointer"], "coffee_machine": ["coffee machine", "espresso", "steam pressure", "water tank", "drip tray"],
    "phone_case": ["phone case", "camera bump", "cutouts line up", "buttons still feel"], "power_bank": ["power bank", "indicator lights", "charged my phone", "cable connection"],
    "kitchen_blender": ["kitchen blender", "frozen berries", "jar locks", "blades rinse"], "gaming_headset": ["gaming headset", "ear cups", "mic quality", "desk setup", "volume wheel"],
    "vacuum_cleaner": ["vacuum cleaner", "low carpet", "main brush", "empty the bin"], "led_desk_lamp": ["led desk lamp", "warm light", "touch panel", "brightness steps"],
    "food_recipe": ["recipe", "dish", "meal", "ingredients", "oven", "cook"], "travel": ["hotel", "flight", "trip", "traveler", "travel", "tour"], "local_business": ["restaurant", "waiter", "service", "table", "menu", "delivery"],
}
