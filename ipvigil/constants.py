"""These must keep exactly these values for results to agree with the data they describe."""

# --- fixed values: score bands, highest first (lower bound, level); anything below the last is RISK_FLOOR
RISK_BANDS = [(90, "critical"), (70, "high"), (40, "medium")]
RISK_FLOOR = "low"
RISK_LEVELS = ["low", "medium", "high", "critical"]

# --- fixed values: public abuse-report category ids
REPORT_CATEGORIES = {
    1: "DNS Compromise",
    2: "DNS Poisoning",
    3: "Fraud Orders",
    4: "DDoS Attack",
    5: "FTP Brute-Force",
    6: "Ping of Death",
    7: "Phishing",
    8: "Fraud VoIP",
    9: "Open Proxy",
    10: "Web Spam",
    11: "Email Spam",
    12: "Blog Spam",
    13: "VPN IP",
    14: "Port Scan",
    15: "Hacking",
    16: "SQL Injection",
    17: "Spoofing",
    18: "Brute-Force",
    19: "Bad Web Bot",
    20: "Exploited Host",
    21: "Web App Attack",
    22: "SSH",
    23: "IoT Targeted",
}

# --- fixed values: hosting companies recognised in AS names, first match wins
CLOUD_PROVIDERS = [
    ("AWS", r"amazon|aws"),
    ("Google Cloud", r"google"),
    ("Microsoft Azure", r"microsoft|azure"),
    ("OVH", r"\bovh\b"),
    ("DigitalOcean", r"digitalocean"),
    ("Hetzner", r"hetzner"),
    ("Alibaba Cloud", r"alibaba"),
    ("Oracle Cloud", r"\boracle\b"),
    ("Linode/Akamai", r"linode|akamai"),
    ("Cloudflare", r"cloudflare"),
    ("Vultr", r"vultr"),
    ("Tencent Cloud", r"tencent"),
]

# --- fixed values: text feeds (source, list, priority, category, score, cap of new addresses per run)
NEW_IPS_PER_SOURCE = 200
TEXT_FEEDS = [
    ("blocklistde", "bruteforcelogin", 1, "Brute-Force", 90.0, 40),
    ("blocklistde", "ssh", 2, "SSH", 85.0, 40),
    ("blocklistde", "bots", 3, "Bad Web Bot", 80.0, 40),
    ("blocklistde", "mail", 4, "Email Spam", 75.0, 40),
    ("blocklistde", "ftp", 5, "FTP Brute-Force", 80.0, 40),
    ("cinsscore", "ci-badguys", 1, "Exploited Host", 85.0, 200),
    ("emergingthreats", "compromised-ips", 1, "Exploited Host", 85.0, 200),
]
BULK_SOURCE = "abuseipdb"
BULK_MIN_SCORE = 25
FEED_SAMPLE_SIZE = 15
REPLAY_POOL_SIZE = 500

# --- fixed values: limits and thresholds of the reports
IPV4_PATTERN = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\z"
QUAD_PATTERN = r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\z"
CIDR_PATTERN = QUAD_PATTERN.removesuffix(r"\z") + r"(/(3[0-2]|[12]?[0-9]))?\z"
IPV6_PATTERN = r"^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,8}\z"
HISTORY_PER_IP = 50
MAX_PAGED_ROWS = 10_000
RECENT_POOL = 2000
TOP_COUNTRIES = 15
MIN_CLUSTER_IPS = 3
CLUSTER_SAMPLE_IPS = 8
REPORTS_READ = 10
LIVE_FEED_ROWS = 40
TREND_ROWS = 200
RECENT_BATCHES = 20
TABLE_TRIGGER = "5 minutes"

# --- fixed values: model settings
CONTAMINATION = 0.02
MODEL_SEED = 42
FOREST_TREES = 200
FOREST_DEPTH = 12
FOREST_BINS = 32
LR_ITERATIONS = 1000
TEST_SHARE = 0.2
ISOLATION_TREES = 100
ISOLATION_SAMPLE = 256
CATEGORICAL_FEATURES = ["source", "country_bucket", "category", "risk_level"]
NUMERIC_FEATURES = ["abuse_confidence_score"]
