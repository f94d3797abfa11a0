"""Every list, weight and threshold of the engine, as one frozen value object.

Functions take a ``Settings`` argument, so a deployment changes behaviour by
passing ``replace(DEFAULT, ...)`` instead of editing code.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: they decide scores and must stay exactly as they are -----
# Inline-script patterns, matched ignoring case; "." stops at a line feed only.
MALICIOUS_PATTERNS = (
    r"<script[^>]*>\s*eval\(.*\)\s*</script>",
    r"document\.write\(.*decodeURIComponent",
    r"atob\(.*\)",
    r"\.addEventListener\(['\"]mouseover['\"]",
    r"window\.open\(\)",
    r"\\x[0-9a-fA-F]{2,}",
)
# "facebook.com/tr" holds a slash, so it never occurs inside a host name.
TRACKER_DOMAINS = (
    "google-analytics.com", "facebook.net", "facebook.com/tr",
    "doubleclick.net", "googlesyndication.com", "amazon-adsystem.com",
    "outbrain.com", "taboola.com", "scorecardresearch.com",
    "criteo.com", "casalemedia.com", "pubmatic.com", "rubiconproject.com",
)
AD_WORDS = ("ad", "banner", "sponsor", "promo", "popup", "advertisement", "advert")
# A deployment appends its own site to this tuple.
TRUSTED_DOMAINS = ("wikipedia.org", "github.com", "stackoverflow.com")
SIGN_IN_ADDRESSES = (
    "accounts.google.com", "login.google.com", "signin.google.com",
    "accounts.youtube.com", "google.com/accounts", "google.com/signin",
)
VIDEO_HOSTS = ("youtube", "vimeo", "dailymotion")
# --- end of fixed values ----------------------------------------------------

# Placed in the head of a page judged unsafe. Any HTML text may be given. It refuses storage,
# cookies, listeners that follow the pointer or the keyboard, the place, the clipboard and direct
# connections between browsers.
PROTECTION_SNIPPET = """<script>(function(){
var no=function(){throw new Error('blocked');},gone=function(){return Promise.reject(new Error('blocked'));};
var put=function(o,n,v){try{Object.defineProperty(o,n,{value:v,writable:false,configurable:false});}catch(e){}};
['localStorage','sessionStorage','indexedDB'].forEach(function(n){try{Object.defineProperty(window,n,{get:no});}catch(e){}});
Object.defineProperty(document,'cookie',{get:function(){return '';},set:function(){}});
var listen=EventTarget.prototype.addEventListener,followed=/^(mouse(move|over|out|enter|leave)|pointer|touchmove|device|key)/;
EventTarget.prototype.addEventListener=function(t){if(!followed.test(t))return listen.apply(this,arguments);};
if(navigator.geolocation)['getCurrentPosition','watchPosition'].forEach(function(n){put(navigator.geolocation,n,no);});
if(navigator.clipboard)['read','readText'].forEach(function(n){put(navigator.clipboard,n,gone);});
['RTCPeerConnection','webkitRTCPeerConnection','RTCDataChannel'].forEach(function(n){put(window,n,undefined);});
})();</script>"""


@dataclass(frozen=True)
class Settings:
    # safety
    malicious_patterns: tuple[str, ...] = MALICIOUS_PATTERNS
    tracker_domains: tuple[str, ...] = TRACKER_DOMAINS
    ad_words: tuple[str, ...] = AD_WORDS
    trusted_domains: tuple[str, ...] = TRUSTED_DOMAINS
    sign_in_addresses: tuple[str, ...] = SIGN_IN_ADDRESSES
    video_hosts: tuple[str, ...] = VIDEO_HOSTS
    malicious_factor: float = 0.3
    tracker_factor: float = 0.8
    ad_factor: float = 0.9
    insecure_factor: float = 0.95
    transport_security_factor: float = 1.05
    refresh_factor: float = 0.9
    safety_threshold: float = 0.7
    protection_snippet: str = PROTECTION_SNIPPET
    # True: advert words and trusted names match at word / dot boundaries only
    strict: bool = False
    # store and crawl
    shard_count: int = 16
    crawl_delay_s: float = 0.5
    analysis_ttl_s: int = 3600
    search_cache_days: int = 30
    slow_latency_s: float = 0.1
    latency_weight: float = 0.9
    # text
    min_keyword_chars: int = 3
    max_keywords: int = 50
    stop_languages: tuple[str, ...] = ("french", "english")
    # search
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_min_idf: float = 1e-6
    per_page: int = 10
    excerpt_words: int = 16
    suggest_limit: int = 5
    # ranking
    weight_similarity: float = 0.5
    weight_share: float = 0.3
    weight_freshness: float = 0.1
    weight_safety: float = 0.1
    min_freshness: float = 0.5
    freshness_days: float = 365.0
    # most frequent terms that a cosine compares; None: all
    max_vocabulary: int | None = None
    forest_trees: int = 100
    forest_seed: int = 42


DEFAULT = Settings()
