"""Small fixed dimensions of digests: display order, labels, extractor routing."""

from __future__ import annotations

# Categories in display order with their signs.
CATEGORIES = (("international", "🌍"), ("ai", "🤖"), ("football", "⚽"), ("realmadrid", "🤍"), ("f1", "🏎️"), ("mlb", "⚾"), ("tabletennis", "🏓"), ("shenzhen", "🏙️"))
FALLBACK_SIGN = "📌"
# Labels of the categories in CATEGORIES' order, by language.
LABELS = {
    "English": ("International", "AI & Tech", "Football", "Real Madrid", "Formula 1", "MLB", "Table Tennis", "Shenzhen"),
    "Chinese": ("国际视野", "AI·大模型", "足球", "皇家马德里", "F1·赛车", "MLB·棒球", "乒乓球", "深圳·国内"),
    "Spanish": ("Panorama Internacional", "IA y Tecnología", "Fútbol", "Real Madrid", "Fórmula 1", "MLB", "Tenis de Mesa", "Shenzhen"),
    "French": ("International", "IA et Tech", "Football", "Real Madrid", "Formule 1", "MLB", "Tennis de Table", "Shenzhen"),
    "German": ("International", "KI & Technik", "Fußball", "Real Madrid", "Formel 1", "MLB", "Tischtennis", "Shenzhen"),
    "Italian": ("Internazionale", "IA e Tecnologia", "Calcio", "Real Madrid", "Formula 1", "MLB", "Tennistavolo", "Shenzhen"),
    "Portuguese": ("Internacional", "IA e Tecnologia", "Futebol", "Real Madrid", "Fórmula 1", "MLB", "Tênis de Mesa", "Shenzhen"),
    "Russian": ("Международные", "ИИ и технологии", "Футбол", "Реал Мадрид", "Формула 1", "MLB", "Настольный теннис", "Шэньчжэнь"),
    "Japanese": ("国際情勢", "AI・テクノロジー", "サッカー", "レアル・マドリード", "F1", "MLB", "卓球", "深セン・国内"),
    "Korean": ("국제", "AI & 테크", "축구", "레알 마드리드", "F1", "MLB", "탁구", "선전·국내"),
}
# Titles of a digest by language; English for the others.
TITLES = {"English": "News Digest", "Chinese": "新闻摘要"}
# Extractors of pages by source name and by host (with and without www.).
EXTRACTOR_BY_NAME = {
    "BBC": "text_blocks", "BBC Sport": "text_blocks", "CNN": "component", "TechCrunch": "article_content", "Marca": "generic", "Managing Madrid": "generic",
    "Football España": "generic", "AS": "generic", "Formula 1": "long", "Motorsport.com": "body_container", "RaceFans": "generic", "澎湃新闻": "generic", "南方都市报": "generic",
}
_HOSTS = {
    "bbc.com": "text_blocks", "bbc.co.uk": "text_blocks", "cnn.com": "component", "techcrunch.com": "article_content", "marca.com": "generic", "managingmadrid.com": "generic",
    "football-espana.net": "generic", "formula1.com": "long", "motorsport.com": "body_container", "racefans.net": "generic", "thepaper.cn": "generic", "nfnews.com": "generic",
}
EXTRACTOR_BY_HOST = {p + h: e for h, e in _HOSTS.items() for p in ("", "www.")} | {"edition.cnn.com": "component", "en.as.com": "generic", "as.com": "generic"}

# The known sources. Feeds of the aggregator are searches; the rest are listing pages or feeds by address.
_SEARCH = "https://news.google.com/rss/search?q={}&hl=en-US&gl=US&ceid=US:en"
_SOURCES = {
    "bbc": ("BBC", "cards", "https://www.bbc.com/news"), "bbc_sport": ("BBC Sport", "sport_links", "https://www.bbc.com/sport"),
    "cnn_world": ("CNN", "spans", "https://edition.cnn.com/world"), "cnn_sport": ("CNN", "spans", "https://edition.cnn.com/sport"),
    "marca": ("Marca", "headings", "https://www.marca.com/en/football/real-madrid.html"), "f1": ("Formula 1", "article_links", "https://www.formula1.com/en/latest.html"),
    "techcrunch": ("TechCrunch", "dated_links", "https://techcrunch.com/category/artificial-intelligence/"), "thepaper": ("澎湃新闻", "numbered", "https://www.thepaper.cn"),
    "nfnews": ("南方都市报", "titled", "https://www.nfnews.com"), "racefans": ("RaceFans", "linked_headings", "https://www.racefans.net"),
    "managing_madrid": ("Managing Madrid", "feed", "https://www.managingmadrid.com/rss/index.xml"), "football_espana": ("Football España", "feed", "https://football-espana.net/category/real-madrid/feed"),
    "motorsport": ("Motorsport.com", "feed", "https://www.motorsport.com/rss/f1/news/"),
}
_SEARCHES = {
    "gn_international": "international+news", "gn_chinanews": "China", "gn_realmadrid": "%22Real+Madrid%22+when:2d", "gn_f1": "Formula+1+Ferrari+Leclerc", "gn_mlb": "MLB+Dodgers",
    "gn_ai": "AI+large+language+model", "gn_shenzhen": "Shenzhen+Guangdong+news", "gn_wtt": "WTT+table+tennis", "gn_ttcn": "China+table+tennis",
    "gn_football": "(football+OR+soccer)+AND+(%22Champions+League%22+OR+%22Premier+League%22+OR+%22La+Liga%22+OR+%22Serie+A%22+OR+%22Bundesliga%22+OR+%22UEFA%22+OR+%22transfer+news%22)+-nfl+-rugby+-hockey",
}
_SOURCES |= {k: ("Google News", "feed", _SEARCH.format(q)) for k, q in _SEARCHES.items()}
# The sources of each category in their order.
_SLOTS = {
    "international": "bbc cnn_world cnn_sport gn_international gn_chinanews", "football": "bbc_sport gn_football", "realmadrid": "marca managing_madrid football_espana gn_realmadrid",
    "f1": "f1 racefans bbc_sport gn_f1 motorsport", "ai": "techcrunch gn_ai", "mlb": "gn_mlb", "shenzhen": "thepaper nfnews gn_shenzhen", "tabletennis": "gn_wtt gn_ttcn",
}
#: category, source_ord, source_key, url, source_name and parser of each slot, as :func:`loomwire.operators.fetch.fetch_items` takes them.
REGISTRY = [(c, i, k, _SOURCES[k][2], _SOURCES[k][0], _SOURCES[k][1]) for c, keys in _SLOTS.items() for i, k in enumerate(keys.split())]
REGISTRY_COLUMNS = "category string, source_ord int, source_key string, url string, source_name string, parser string"
