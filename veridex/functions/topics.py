"""Topics: search queries, communities, subdomains and start addresses, as rows made of fixed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridex.functions.text import array_of, quoted

#: What is added to a question to find reliable and unreliable sources; "" for other topics.
QUERY_WORDS = {
    "public_health": {
        "reliable": ["government", "research", "guidelines", "academic", "clinical study", "peer reviewed"],
        "unreliable": ["reddit", "twitter", "natural medicine", "alternative treatment", "conspiracy", "natural news", "big pharma", "cover up", "holistic cure", "mercola", "viral"],
    },
    "current_events": {
        "reliable": ["news", "breaking news", "Reuters AP", "official statement", "government response", "fact check", "verified report", "press release", "BBC CNN", "NPR"],
        "unreliable": ["reddit", "twitter", "conspiracy", "cover up", "deep state", "mainstream media lies", "alternative media", "truth exposed", "fake news", "infowars"],
    },
    "history": {
        "reliable": ["historical research", "academic study", "archaeological evidence", "historical records", "scholarly article", "museum", "documented evidence", "peer reviewed history", "Smithsonian", "National Geographic"],
        "unreliable": ["reddit", "twitter", "conspiracy", "hidden history", "cover up", "ancient aliens", "lost civilization", "forbidden archaeology", "alternative history", "ancient code"],
    },
    "finance": {
        "reliable": ["analysis", "research report", "financial data", "market analysis", "expert opinion", "economic forecast", "institutional report", "SEC filing", "Bloomberg", "Wall Street Journal"],
        "unreliable": ["reddit", "twitter", "get rich quick", "market crash", "economic collapse", "conspiracy", "manipulation", "pump and dump", "insider secret", "zero hedge"],
    },
    "sports": {
        "reliable": ["official news", "sports news", "league report", "official statement", "verified report", "press conference", "sports journalism", "team announcement", "ESPN", "official league"],
        "unreliable": ["reddit", "twitter", "rumor", "gossip", "unconfirmed", "speculation", "fan theory", "hot take", "controversial opinion", "barstool"],
    },
    "": {
        "reliable": ["research", "academic", "study", "analysis", "expert opinion", "official", "verified"],
        "unreliable": ["reddit", "twitter", "conspiracy", "alternative", "unverified", "rumor", "speculation"],
    },
}
#: Communities by topic; "" for other topics.
COMMUNITIES = {
    "public_health": ["health", "nutrition", "fitness", "mentalhealth", "medical", "wellness", "supplements", "herbalism", "homeopathy", "alternative", "conspiracy", "naturalmedicine", "holistic"],
    "current_events": ["news", "worldnews", "politics", "conspiracy", "conspiracytheories", "alternative", "truth", "exposing", "realnews", "worldpolitics", "politicaldiscussion"],
    "history": ["history", "ancienthistory", "conspiracy", "alternativehistory", "archaeology", "mystery", "unsolvedmysteries", "ancientaliens", "forbiddenhistory", "hiddenhistory", "lostcivilizations"],
    "finance": ["investing", "wallstreetbets", "cryptocurrency", "personalfinance", "conspiracy", "economiccollapse", "preppers", "gold", "silver", "bitcoin", "cryptomarkets", "financialindependence"],
    "sports": ["sports", "nba", "nfl", "soccer", "baseball", "tennis", "conspiracy", "sportscorruption", "olympics", "ufc", "boxing"],
    "climate": ["climatechange", "environment", "climate", "globalwarming", "conspiracy", "climateskeptics", "geoengineering", "chemtrails", "environmental", "sustainability", "renewableenergy"],
    "technology": ["technology", "artificialintelligence", "programming", "cybersecurity", "conspiracy", "privacy", "surveillance", "5g", "quantumcomputing", "machinelearning", "datascience", "blockchain"],
    "astronomy": ["astronomy", "space", "nasa", "cosmology", "conspiracy", "ufo", "aliens", "spacex", "mars", "moon", "stars", "galaxies", "blackholes", "exoplanets"],
    "law": ["law", "legaladvice", "conspiracy", "politics", "government", "constitutional", "supremecourt", "civilrights", "legal", "justice", "criminaljustice", "humanrights"],
    "psychology": ["psychology", "mentalhealth", "science", "conspiracy", "neuroscience", "cognitive", "behavioral", "therapy", "psychiatry", "mindfulness", "consciousness"],
    "": ["conspiracy", "alternative", "truth", "exposing", "realnews"],
}
#: Subdomains of each topic.
SUBDOMAINS = {
    "public_health": ["vaccines", "infectious_diseases", "nutrition_guidelines", "mental_health", "maternal_and_child_health", "chronic_diseases", "occupational_safety", "toxicology", "emergency_medicine", "preventive_care", "healthcare_policy", "medical_research", "public_health_education"],
    "current_events": ["international_conflicts", "elections", "natural_disasters", "pandemics", "economic_crises", "major_legislation", "scientific_breakthroughs", "protests_and_movements"],
    "history": ["ancient_civilizations", "world_wars", "revolutions", "colonialism", "cold_war", "civil_rights_movements", "historical_figures", "archaeological_discoveries", "us-history"],
    "finance": ["stock_markets", "banking", "cryptocurrency", "inflation_and_recession", "personal_finance", "global_trade", "housing_markets", "investment_strategies"],
    "sports": ["olympics", "soccer", "basketball", "baseball", "tennis", "athletics", "sports_medicine", "sports_history", "doping_scandals", "football"],
    "climate": ["climate_change", "carbon_emissions", "renewable_energy", "sea_level_rise", "deforestation", "pollution", "sustainable_development", "climate_policy"],
    "technology": ["artificial_intelligence", "social_media", "cybersecurity", "5g_networks", "biotechnology", "quantum_computing", "software_and_internet", "consumer_electronics"],
    "astronomy": ["planets_and_moons", "stars_and_galaxies", "black_holes", "space_exploration", "telescopes", "cosmology", "exoplanets", "astrobiology", "universe_origin", "moon_landing"],
    "law": ["constitutional_law", "criminal_law", "international_law", "civil_rights", "supreme_court_cases", "intellectual_property", "environmental_law", "human_rights_law", "immigration_law"],
    "psychology": ["clinical_psychology", "cognitive_psychology", "developmental_psychology", "social_psychology", "behavioral_psychology", "neuropsychology", "forensic_psychology", "health_psychology", "industrial_psychology", "educational_psychology", "abnormal_psychology", "personality_psychology", "experimental_psychology", "counseling_psychology", "sports_psychology"],
}
#: Where a crawl begins: searches for the first keywords, then front pages.
SEARCHES = [
    "https://www.mayoclinic.org/search?q=", "https://www.webmd.com/search/search_results/default.aspx?query=", "https://www.healthline.com/search?q1=",
    "https://medlineplus.gov/search/?q=", "https://www.cdc.gov/search/?q=", "https://www.naturalnews.com/search.asp?query=",
    "https://www.mercola.com/search.aspx?q=", "https://www.greenmedinfo.com/search/site/",
]
FRONT_PAGES = [
    "https://www.mayoclinic.org", "https://www.webmd.com", "https://www.healthline.com", "https://medlineplus.gov", "https://www.nih.gov",
    "https://www.cdc.gov", "https://www.naturalnews.com", "https://www.mercola.com", "https://www.greenmedinfo.com",
]


def _listed(topic: str, lists: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN {quoted(t)} THEN {array_of(v)}" for t, v in lists.items() if t)
    return f"CASE {topic} {cases} ELSE {array_of(lists.get('', []))} END"


def search_queries(question: str, topic: str, kind: str) -> str:
    """The question, then with each of its topic's words behind it. kind: reliable or unreliable."""
    return f"concat(array({question}), transform({_listed(topic, {t: v[kind] for t, v in QUERY_WORDS.items()})}, w -> concat({question}, ' ', w)))"


def communities(topic: str) -> str:
    return _listed(topic, COMMUNITIES)


def start_urls(gold_url: str, keywords: str, most: int = 15) -> str:
    found = f"if(size({keywords}) > 0, transform({array_of(SEARCHES)}, u -> concat(u, array_join(slice({keywords}, 1, 3), '+'))), cast(array() AS array<string>))"
    return f"slice(concat(if(coalesce({gold_url}, '') = '', cast(array() AS array<string>), array({gold_url})), {found}, {array_of(FRONT_PAGES)}), 1, {most})"


def subdomains(spark: SparkSession) -> DataFrame:
    """(topic, subdomain)"""
    return spark.createDataFrame([(t, s) for t, v in SUBDOMAINS.items() for s in v], "topic string, subdomain string")


def subdomain_places(spark: SparkSession) -> DataFrame:
    """(topic, subdomain, nth): each topic's subdomains, numbered from 0."""
    return spark.createDataFrame([(t, s, i) for t, v in SUBDOMAINS.items() for i, s in enumerate(v)], "topic string, subdomain string, nth int")
