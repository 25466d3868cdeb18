"""Dimension data. Word lists, labels, patterns and thresholds that results depend on."""

from __future__ import annotations

# -- fixed values: pages ------------------------------------------------------------------------
TRACKING_KEYS = ("fbclid", "gclid", "gbraid", "wbraid", "igshid", "mc_cid", "mc_eid", "ref", "source", "src", "_hsenc", "_hsmi")
SUPPORTED_CLASSES = ("commerce_pdp", "image_heavy_commerce_pdp", "marketing_only_pdp", "product_marketing_page", "support_spec_page", "document_download_heavy_support_page")
SUPPORT_CLASSES = ("support_spec_page", "document_download_heavy_support_page")
BLOCKER = ("access denied", "captcha", "forbidden", "system error", "시스템오류", "challenge-platform")
BLOCKER_HTML = ("window.awswafcookiedomainlist", "gokuprops", "__cf_bm", "cf-chl-", "challenge-form")
WAITING = ("waiting room", "queue", "잠시만", "대기열", "접속자가 많")
SUPPORT = ("기술 사양", "specifications", "지원", "battery life", "cpu", "memory", "호환")
DOWNLOAD = ("download", "manual", "pdf", "설명서", "다운로드")
PROMO = ("이벤트", "혜택", "쿠폰", "benefit", "sale", "offer", "프로모션", "할인")
BUY = ("장바구니", "구매하기", "add to cart", "buy now", "cart", "checkout")
STOCK = ("in stock", "재고", "품절", "out of stock")
#: What counts as white space between words, written so that Java and RE2 read it alike.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Price patterns; a word bound is written out, so that every regex engine reads it alike.
_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
PRICE = (f"₩{SPACE}?[0-9]", rf"\${SPACE}?[0-9]", _EDGE + r"[0-9]{2,3},[0-9]{3}" + _END, _EDGE + r"[0-9]{4,6}" + _END)
PRODUCT_URL = ("/products/", "/product/", "/shop/product/", "/display/event_detail", "/shop/buy-", "/mobile-accessories/", "goodsdetail.do", "/product/view", "productcd=", "goodsno=")
LANDING_URL = ("/display/main", "/display/event", "/display/live", "/display/rank", "/display/giftrecommend")
SUPPORT_TITLE = ("기술 사양", "specifications", "support", "지원")
HERO_NOUNS = ("pro", "mask", "cream", "cloudtilt", "airpods", "macbook", "iphone", "galaxy", "case", "retinol", "keyboard", "pencil")
MARKETPLACES = ("amazon", "coupang", "ebay", "gmarket", "naver", "smartstore", "tmall", "wconcept", "11st")
EVIDENCE_MARKETPLACES = ("amazon", "coupang", "gmarket", "11st", "smartstore", "naver", "oliveyoung")
KNOWN_HOSTS = {"laneige": "Laneige", "aesop": "Aesop", "apple": "Apple", "drjart": "Dr.Jart+", "on": "On", "onrunning": "On"}
HOST_NOISE = ("www", "m", "kr", "ko", "com", "co")

#: Hints of a failure, by what the error text holds.
FETCH_HINTS = (
    (("timed out", "timeout"), "page response or browser render exceeded the collector timeout"),
    (("forbidden", "access denied", "captcha", "challenge", "blocked"), "origin likely returned a blocker, WAF challenge, or anti-bot interstitial"),
    (("ssl", "tls", "certificate"), "TLS or certificate negotiation failed before HTML could be collected"),
    (("getaddrinfo", "name or service not known", "temporary failure in name resolution", "dns"), "DNS resolution failed for the target host"),
    (("connection refused", "connection reset", "remote end closed", "reset by peer"), "origin connection failed before the collector could read the page"),
    (("empty html",), "browser render returned no usable DOM; a cookie wall, JS app shell, or bot interstitial is likely"),
    (("no module named 'crawl4ai'", "pydantic_core"), "Crawl4AI runtime environment is misconfigured or missing binary dependencies"),
)
RENDERED_HINT = "this URL is on the browser-render fallback path; Playwright or the browser runtime may be the failing dependency"
PLAIN_HINT = "if the page depends on client-side rendering, retry it through the Crawl4AI fallback collector"
SNAPSHOT_HINTS = ("collected HTML could not be normalized into snapshot fields", "the response shows charset or mojibake flags, so decoded text may be corrupted", "the collector received an HTTP error page instead of a normal product page")
RECOGNITION_HINT = "OCR execution failed after collection completed"
RECOGNITION_HINTS = (
    (("timeout",), "the OCR image sweep exceeded the configured timeout"),
    (("paddle", "ocr", "subprocess"), "the PaddleOCR subprocess or OCR runtime dependency likely failed"),
    (("not found", "no such file", "cannot find"), "the configured OCR python runtime or dependency path may be missing"),
)
CLASS_HINTS = {
    "blocked_page": ("the collector reached a blocker or challenge page instead of product content", "retry through the Crawl4AI fallback profile only if this domain is known to require browser rendering"),
    "waiting_page": ("the page is behind a queue or waiting-room interstitial", "retry later or with a session-authenticated fetch if that path is allowed"),
    "promo_heavy_commerce_landing": ("single-product identity was not proven strongly enough from product, price, and buy-intent signals", "the URL looks closer to a promo landing page or listing than a single PDP"),
    "non_product_page": ("product-name, price, or buy-intent signals were too weak for a sellable PDP",),
}
OTHER_CLASS_HINT = " is currently outside the supported generation path"
NO_DATA_HINT, NO_BUY_HINT = "no structured product data was admitted on this page", "buy-intent signals were missing from the collected page text"

# -- fixed values: keywords ---------------------------------------------------------------------
CATEGORY_TARGETS = {"brand": 10, "generic_category": 12, "feature_attribute": 18, "competitor_comparison": 8, "purchase_intent": 12, "long_tail": 16, "benefit_price": 6, "season_event": 6, "problem_solution": 12}
IDEAL_SHARES = {"brand": 0.10, "generic_category": 0.12, "feature_attribute": 0.18, "competitor_comparison": 0.08, "purchase_intent": 0.12, "long_tail": 0.16, "benefit_price": 0.06, "season_event": 0.06, "problem_solution": 0.12}
NEGATIVE = "negative"
NAVER_LABELS = ("완전일치", "확장소재", "제외키워드")
GOOGLE_LABELS = ("exact", "phrase", "broad", "negative")
BANNED_TERMS = ("할인", "쿠폰", "최저가", "특가", "무료배송", "즉시출고", "당일배송", "재고임박", "마감임박", "품절임박")
DOC_BOILERPLATE = ("설명서", "매뉴얼", "다운로드", "download", "manual", "spec", "specs")
LOW_INFORMATION = ("검색", "정리", "탐색", "베스트", "카테고리", "정식", "중심", "기반")
UNITS = ("ml", "g", "kg", "inch", "in", "gb", "tb", "mah", "hz", "w")
PLACEHOLDER_PRODUCTS = ("제품", "상품", "product", "products", "item", "items", "goods")
HARD_ISSUES = ("empty_keyword", "repeated_phrase", "placeholder_unit", "doc_boilerplate", "invalid_exact", "invalid_negative", "invalid_competitor", "placeholder_product_term", "domain_mismatch_phrase")
FILLER_SUFFIXES = ("특성 검색", "카테고리 검색", "브랜드 검색", "비교 검색", "구매 검색", "정보 검색", "효능 검색", "상황 검색", "문제 해결")
EVAL_BOILERPLATE = ("지원", "사양", "기술", "download", "manual", "spec", "specs")
LIGHT_FILLERS = ("검색", "정리", "가이드", "카테고리", "정보", "탐색")
MODIFIERS = ("추천", "후기", "리뷰", "비교", "구매", "정리", "공식", "정품", "사용감", "효과", "장점", "효능", "선택", "가이드", "정보", "스펙", "특징", "성능", "기능", "필요", "해결", "체크", "대안", "대체", "옵션", "라인", "만족도")
DUPLICATE_SUFFIXES = ("추천", "후기", "리뷰", "비교", "구매", "정품", "공식")
NEGATIVE_SEEDS = ("중고", "리퍼", "수리", "부품", "케이스만", "충전기만", "설명서", "매뉴얼", "다운로드", "무료체험")
QUALITY_BASE = {"high": 1.00, "medium": 0.72, "low": 0.45}
BASE_FACTS = ("product_name", "brand", "product_category")
RICH_FACTS = ("benefit", "key_ingredient", "usage", "use_case", "problem_solution", "volume", "variant", "texture", "audience")
COMMERCE_CLASSES = ("commerce_pdp", "image_heavy_commerce_pdp")
WARNING_CLASSES = ("image_heavy_commerce_pdp", "support_spec_page", "document_download_heavy_support_page")
EXPORT_COLUMNS = ("url", "product_name", "category", "keyword", "naver_match", "google_match", "reason", "quality_warning")
# -- end of fixed values ------------------------------------------------------------------------

#: Keyword templates of the deterministic row source: order, category, pattern, reason, evidence tier, quality.
TEMPLATES = (
    (1, "brand", "{b}", "brand of the product", "direct", "high"),
    (2, "brand", "{b} {n}", "brand and name", "direct", "high"),
    (3, "generic_category", "{t}", "type", "inferred", "medium"),
    (4, "generic_category", "{t} 추천", "type with modifier", None, "low"),
    (5, "feature_attribute", "{n} 성능", "attribute of it", "weak", "medium"),
    (6, "feature_attribute", "{n} 정보 가이드", "", "weak", "low"),
    (7, "competitor_comparison", "{b} {t} 비교", "brand against type", "inferred", "medium"),
    (8, "purchase_intent", "{n} 구매", "purchase", "direct", "high"),
    (9, "purchase_intent", "{b} {n} 구매", "purchase of the brand", "direct", None),
    (10, "long_tail", "{b} {n} {t} 추천 후기", "long phrase of all", "inferred", "medium"),
    (11, "long_tail", "{t} {t} 추천", "repeated", "weak", "low"),
    (12, "benefit_price", "{n} 최저가", "price", "direct", "high"),
    (13, "benefit_price", "{n} 가격 500 ml", "price of a size", "direct", "medium"),
    (14, "season_event", "{t} 선물용", "season", "weak", "medium"),
    (15, "problem_solution", "{n} 문제 해결", "problem", "inferred", "low"),
    (16, "problem_solution", "{n} 탐색 3", "probe", "weak", "low"),
    (17, "negative", "중고", "not wanted", None, None),
    (18, "negative", "{n} 중고", "not wanted of it", None, None),
    (19, "negative", "{b} 해외", "not in the seeds", None, None),
)

# -- fixed values: images -----------------------------------------------------------------------
IMAGE_SOURCES = ("src", "data-src", "data-lazy-src", "data-original", "ec-data-src", "srcset")
DETAIL_PATHS = ("/web/upload/webp/", "/web/upload/", "/web/product/extra/", "/editor/", "/detail/", "/content/", "_detail", "_result")
SPEC_TOKENS = ("spec", "specification", "battery", "memory", "cpu", "ingredient", "ingredients", "material", "volume", "capacity", "compare", "comparison", "shade", "size")
REJECT_IMAGES = ("logo", "icon", "sprite", "badge", "thumbnail", "favicon")
REJECT_EXTENSIONS = (".svg", ".gif", ".ico")
REJECT_HOSTS = ("echosting.cafe24.com",)
REJECT_PATHS = ("/web/upload/images/", "/web/product/small/", "header_scope", "ico_", "icn-")
REJECT_TEMPLATES = ("'+", "+'", "${", "{{", "}}")
PRIORITY_IMAGES = ("hero", "gallery", "detail", "spec", "product", "slide", "main")
TABLE_IMAGES = ("table", "spec", "specification", "chart", "grid", "compare", "comparison", "matrix", "guide", "size", "shade", "swatch")
FRONT_LABELS = ("label", "front", "package", "packaging", "bottle", "box", "ingredient")

# -- fixed values: product types ----------------------------------------------------------------
PRODUCT_TYPES = {
    "skincare": ("retinol", "레티놀", "serum", "cream", "mask", "sleeping", "moisturizer", "hydrator", "스킨케어", "세럼", "크림", "마스크", "보습"),
    "smartphone": ("iphone", "아이폰", "galaxy", "갤럭시", "smartphone", "phone", "mobile", "휴대폰", "핸드폰", "pixel", "픽셀", "xiaomi", "샤오미"),
    "phone_case": ("case", "케이스", "silicone", "실리콘", "cover", "커버", "magsafe", "맥세이프"),
    "protein_food": ("닭가슴살", "chicken breast", "protein", "단백질", "랭킹닭컴", "맛있닭", "냉동"),
    "electronics": ("macbook", "laptop", "notebook", "노트북", "맥북", "spec", "manual"),
    "audio": ("airpods", "earbud", "이어버드", "이어폰", "헤드폰"),
    "footwear": ("shoe", "shoes", "sneaker", "running", "러닝화", "스니커즈", "신발"),
}
COMPETITORS = {
    "skincare": ("이니스프리", "메디힐", "닥터자르트", "에스트라", "아이오페"),
    "smartphone": ("갤럭시", "Galaxy", "삼성", "Samsung", "샤오미", "Xiaomi", "픽셀", "Pixel", "아이폰", "iPhone"),
    "phone_case": ("스피젠", "슈피겐", "링케", "ESR", "OtterBox", "UAG", "엘라고", "아라리", "벨킨", "테크21", "카카오프렌즈", "모란카노", "아이폰", "iPhone"),
    "protein_food": ("하림", "참프레", "굽네", "허닭", "아임닭", "잇메이트"),
    "footwear": ("살로몬", "콜롬비아", "머렐", "블랙야크", "호카"),
    "audio": ("소니", "보스", "JBL", "삼성", "애플"),
    "electronics": ("삼성", "LG", "레노버", "델", "HP", "ASUS", "애플"),
    "general": (),
}
SKINCARE_BLOCKED = ("업무용", "기본형", "기본 사양", "기본 성능", "기본 기능", "대표 모델", "라인업", "시리즈", "퍼포먼스", "트레이닝", "라이프스타일")
# -- end of fixed values ------------------------------------------------------------------------

# -- fixed values: slots ------------------------------------------------------------------------
DEFAULT_SLOTS = {"brand": "product_name", "generic_category": "generic_type_phrase", "feature_attribute": "spec", "competitor_comparison": "competitor_brand_type", "purchase_intent": "navigational_alias", "long_tail": "use_case_phrase", "benefit_price": "product_price", "season_event": "seasonal_context", "problem_solution": "problem_noun_phrase", "negative": "negative_exclusion"}
# -- end of fixed values ------------------------------------------------------------------------

# -- fixed values: evidence ---------------------------------------------------------------------
EVIDENCE_COMMERCE = ("commerce_pdp", "image_heavy_commerce_pdp", "marketing_only_pdp", "product_marketing_page")
CATEGORY_HINTS = {
    "wireless earbuds": ("airpods", "earbud", "earbuds", "wireless earbuds"),
    "laptop": ("macbook", "laptop", "notebook"),
    "running shoes": ("cloudtilt", "shoe", "shoes", "sneaker", "running"),
    "skincare": ("mask", "cream", "retinol", "sleeping", "skincare", "moisturizer", "serum"),
}
SUPPORT_MARKERS = ("apple support", "support", "tech specs", "specs", "spec", "technical specifications", "download", "manual")
STORE_MARKERS = ("official store", "official", "online store", "korea", "kr")
GENERIC_ATTRIBUTES = ("ingredient", "material", "volume", "battery", "compatibility", "cpu", "memory")
ATTRIBUTE_WORDS = ("cpu", "memory", "battery", "compatibility", "ingredient", "material", "volume", "processor")
EVIDENCE_UNITS = ("ml", "g", "kg", "oz", "inch", "in", "gb", "tb", "mah", "hz", "w")
INGREDIENTS = (
    r"(?:순도\s*\d+%?\s*)?(?:초순수\s*)?(레티놀|retinol)",
    r"(트리펩타이드|tripeptide)",
    r"((?:\d+\s*d\s*)?(?:히알루론산|hyaluronic acid))",
    r"(세라마이드|ceramide)",
    r"(나이아신아마이드|niacinamide)",
    r"(스쿠알란|squalane)",
    r"(콜라겐|collagen)",
    r"(펩타이드|peptide)",
)
TECHNOLOGIES = (r"\b([A-Za-z][A-Za-z0-9.+-]{3,}(?:\s?[A-Za-z0-9.+-]+){0,2})\b", r"(?i)((?:\d+\s*d\s*)?(?:히알루론산|hyaluronic acid))")
TECHNOLOGY_PARTS = ("tox", "complex", "technology", "tech", "5d", "3d", "micro")
CATALOG_FORMS = ("cleanser", "skin", "mist", "lotion", "emulsion", "serum", "essence", "gel", "cream", "mask", "toner")
CATALOG_MARKERS = ("view all", "by type", "all products", "category", "categories", "lineup")
BADGES = ("best seller", "new arrival", "award winner", "international", "lbll", "bestseller", "limited", "exclusive")
BENEFIT_VERBS = r"(?:개선|완화|케어|커버|improves?|supports?)"
BENEFIT_ENDS = ("개선", "완화", "케어", "커버")
BENEFIT_STOPS = ("my first", "skin", "product", "나의 첫", "피부", "제품")
BENEFIT_AREAS = ("주름", "모공", "탄력", "wrinkle", "pore", "firm")
LIFTED_TYPES = ("benefit", "key_ingredient", "usage", "use_case", "problem_solution", "volume", "variant", "texture")
MODEL_NAMES = (r"(?i)\bapple\s+(macbook\s+(?:pro|air)\s+\d{2})\b", r"(?i)\b(macbook\s+(?:pro|air)\s+\d{2})\b", r"(?i)\b(airpods(?:\s+pro)?(?:\s+\d+)?)\b", r"(?i)\b(ipad\s+(?:pro|air|mini)?(?:\s+\d+(?:th)?\s*gen)?)\b")

# -- fixed values: interpretation ---------------------------------------------------------------
STORE_TOKENS = ("한국", "대한민국", "kr", "korea", "공식몰", "공식", "온라인", "스토어", "support", "지원")
SHALLOW_TOKENS = ("추천", "후기", "리뷰", "비교", "정품", "공식", "사용법", "가이드", "브랜드", "공식몰", "카테고리")
SELECTION_MODIFIERS = ("추천", "후기", "리뷰", "비교", "구매", "정품", "공식", "사용법", "가이드", "정보", "스펙", "특징", "장점", "효과")
VALUE_TERMS = ("가성비", "합리적 가격", "합리적인 가격", "경제적", "경제적인", "best value", "value for money")
EVENT_TERMS = ("블랙프라이데이", "black friday", "사이버먼데이", "cyber monday", "프라임데이", "prime day", "boxing day", "광군제", "11.11")
BROAD_CATEGORIES = ("스킨케어", "화장품", "코스메틱", "제품", "상품", "general", "product", "products")
BROAD_HEADS = ("스킨케어", "화장품", "코스메틱", "제품", "상품")
FORM_WORDS = ("타입", "제형", "텍스처", "질감")
CATEGORY_TERMS = {
    "skincare": {
        "retinol": ("레티놀 세럼", "레티놀 크림", "민감 피부 레티놀", "레티놀 스킨케어"),
        "레티놀": ("레티놀 세럼", "레티놀 크림", "민감 피부 레티놀", "레티놀 스킨케어"),
        "serum": ("세럼", "보습 세럼", "스킨케어 세럼"),
        "세럼": ("세럼", "보습 세럼", "스킨케어 세럼"),
        "cream": ("보습 크림", "장벽 크림", "페이스 크림"),
        "크림": ("보습 크림", "장벽 크림", "페이스 크림"),
        "mask": ("슬리핑 마스크", "보습 마스크", "수분 마스크"),
        "마스크": ("슬리핑 마스크", "보습 마스크", "수분 마스크"),
        "default": ("스킨케어", "보습 케어", "민감 피부 케어"),
    },
    "smartphone": {
        "iphone": ("스마트폰", "휴대폰", "핸드폰"),
        "아이폰": ("스마트폰", "휴대폰", "핸드폰"),
        "galaxy": ("스마트폰", "휴대폰", "핸드폰"),
        "갤럭시": ("스마트폰", "휴대폰", "핸드폰"),
        "default": ("스마트폰", "휴대폰", "핸드폰"),
    },
    "phone_case": {
        "case": ("케이스", "폰 케이스", "스마트폰 케이스", "실리콘 케이스"),
        "케이스": ("케이스", "폰 케이스", "스마트폰 케이스", "실리콘 케이스"),
        "silicone": ("실리콘 케이스", "케이스", "폰 케이스"),
        "실리콘": ("실리콘 케이스", "케이스", "폰 케이스"),
        "default": ("케이스", "폰 케이스", "스마트폰 케이스", "실리콘 케이스"),
    },
    "protein_food": {
        "닭가슴살": ("닭가슴살", "소스 닭가슴살", "단백질 식품"),
        "chicken breast": ("닭가슴살", "소스 닭가슴살", "단백질 식품"),
        "protein": ("단백질 식품", "닭가슴살"),
        "default": ("닭가슴살", "소스 닭가슴살", "단백질 식품"),
    },
    "electronics": {"macbook": ("노트북", "프로 노트북", "업무용 노트북"), "default": ("전자기기", "디지털 기기")},
    "audio": {"earbud": ("무선 이어폰", "블루투스 이어폰", "노이즈캔슬링 이어폰"), "default": ("오디오 기기", "무선 오디오")},
    "footwear": {"running": ("러닝화", "데일리 러닝화", "쿠셔닝 러닝화"), "default": ("신발", "데일리 슈즈", "라이프스타일 슈즈")},
}
#: Terms that count as negatives, with the product types they are allowed for.
NEGATIVE_TERMS = {
    "중고": ("skincare", "footwear", "audio", "electronics", "general"),
    "샘플": ("skincare",),
    "도매": ("skincare", "general"),
    "공병": ("skincare",),
    "원료": ("skincare",),
    "만들기": ("skincare",),
    "재판매": ("skincare", "general"),
    "OEM": ("skincare",),
    "리퍼": ("electronics", "audio"),
    "수리": ("electronics", "audio"),
}
COMPARISON_TERMS = {t: ("skincare", "footwear", "audio", "electronics", "general") for t in ("대안", "대체", "옵션 비교", "라인 비교")}
PROBLEM_TERMS = {t: ("skincare",) for t in ("민감 피부", "건조", "장벽", "탄력", "트러블")}
SEASON_TERMS = {t: ("skincare",) for t in ("야간 케어", "데일리 루틴", "건조한 날씨", "겨울 보습")} | {t: ("skincare", "footwear", "audio", "electronics", "general") for t in ("입문용", "일상용")}
TAXONOMIES = {"negative_seed": NEGATIVE_TERMS, "competitor_comparison": COMPARISON_TERMS, "problem_solution": PROBLEM_TERMS, "season_event": SEASON_TERMS}

# -- fixed values: surfaces ---------------------------------------------------------------------
SURFACE_SCAFFOLDS = ("구매 전 체크", "구매 준비", "구매 상담", "구매 문의", "구매 타이밍", "결제 옵션", "고민 해결", "필요 이유", " 효익", "만족도", " 해결", "구매처", "판매처", "재고", "배송")
SURFACE_ACTIONS = ("그림 그리기", "메모", "문서 주석 작성", "주석 작성", "drawing", "note taking", "taking notes", "annotation", "annotating", "auto pairing")
SURFACE_INFORMATION = ("방법", "사용법", "가이드", "guide", "how to", "tutorial", "설정", "세팅", "연결", "pairing", "호환 방법")
PURCHASE_SUFFIXES = ("구매", "주문", "구입", "buy", "order", "shop")
SURFACE_MERCHANDISE = ("베스트셀러", "어워드 위너", "신상품")
FEATURE_SCAFFOLDS = (" 특징", " 장점", " 효과")
SEASON_SCAFFOLDS = ("데일리 루틴", "건조한 날씨")
BARE_SUFFIXES = ("장벽", "건조")
COMPARISON_SHAPES = ("용량 비교", "가격 비교", "옵션 비교", "라인 비교")
PURPOSE_ENDS = ("입문용", "일상용")
SURFACE_PENALTIES = {"surface_scaffold": 0.12, "surface_merchandising": 0.12, "surface_feature_scaffold": 0.12, "surface_product_prefix": 0.10, "surface_price_shape": 0.10, "surface_season_scaffold": 0.12, "surface_product_purpose_suffix": 0.12, "surface_ungrounded_feature": 0.15, "surface_ungrounded_season": 0.15, "surface_ungrounded_problem": 0.15}
HARD_SURFACES = ("surface_product_action", "surface_informational", "surface_purchase_suffix", "surface_raw_price", "surface_unsupported_event", "surface_competitor_shape")
COMPETITOR_BLOCKED = ("스킨케어", "제품", "상품", "카테고리")
SLOT_ORDER = {
    "brand": ("product_name", "brand_with_type", "navigational_alias"),
    "generic_category": ("generic_type_phrase",),
    "feature_attribute": ("spec", "core_attribute"),
    "competitor_comparison": ("competitor_brand_type",),
    "purchase_intent": ("navigational_alias", "brand_with_type"),
    "long_tail": ("use_case_phrase", "audience_phrase"),
    "benefit_price": ("product_price", "price_band"),
    "season_event": ("grounded_event", "seasonal_context"),
    "problem_solution": ("problem_noun_phrase",),
    "negative": ("negative_exclusion",),
}
DEFAULT_REASONS = {"brand": "브랜드 및 제품명 직접 근거 기반", "generic_category": "제품 카테고리 직접 근거 기반", "feature_attribute": "제품 속성 및 스펙 근거 기반", "competitor_comparison": "동일 제품군 경쟁 브랜드 탐색 기반", "purchase_intent": "제품명 및 브랜드 탐색 의도 기반", "long_tail": "제품 특성 조합 확장 기반", "benefit_price": "가격 및 효익 탐색 기반", "season_event": "시즌 및 상황 탐색 기반", "problem_solution": "문제 해결 및 효익 탐색 기반", "negative": "전환 의도가 낮은 제외 키워드 기반"}
OTHER_REASON = "근거 기반 키워드"

# -- fixed values: recognised text --------------------------------------------------------------
PROMO_WORDS = ("sale", "offer", "benefit", "promo", "coupon", "event", "discount")
PRODUCT_FIELDS = ("제품명", "품질표시사항", "품질 표시 사항", "재질", "제조국", "원산지", "수입원", "판매원", "제조", "판매", "가격", "소비자가격", "권장소비자가", "용량", "중량", "규격", "성분", "전성분", "원재료", "재료", "ingredient", "ingredients", "material", "made in", "price", "volume", "capacity")
RECOGNITION_UNITS = ("ml", "g", "kg", "oz", "inch", "in", "gb", "tb", "mah", "hz", "w", "cm", "mm")
COMMON_WORDS = ("with", "for", "and", "the")
# -- end of fixed values ------------------------------------------------------------------------
