"""Word lists, patterns and formats that results depend on."""

# --- Fixed values: URL rules ---
TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "_t", "_", "t", "token", "session", "sid", "random", "_dc", "nocache", "v", "ver", "timestamp", "ts"]
SKIP_SCHEMES = ["mailto:", "javascript:", "tel:", "ftp:"]
PAGE_SKIP_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".json", ".xml", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".mp3", ".mp4", ".avi"]
LINK_SKIP_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".json", ".xml", ".rss", ".atom", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".rar", ".7z", ".mp4", ".mp3", ".avi", ".mov", ".wmv"]
SEARCH_PATHS = ["/s", "/search", "/query", "/cse/search"]
REDIRECT_PATHS = ["/link", "/redirect", "/goto", "/jump", "/url"]
HOME_ENDINGS = ["/index", "/home", "/default", "/main"]
LIST_URL_WORDS = ["list", "lists", "category", "categories", "cat", "page", "pages", "archive", "archives", "tag", "tags", "search", "query", "index", "catalog", "grid", "liebiao", "fenlei", "mululiebiao"]
LIST_LINK_TEXTS = ["更多", "全部", "所有", "查看全部", "查看更多", "more", "all", "view all", "read more"]

# --- Fixed values: page classification ---
PLACEHOLDERS = ["data:image", "1x1", "placeholder", "lazy", "spacer", "blank.gif", "blank.png", "loading.gif", "loading.svg", "transparent", "pixel.gif", "pixel.png", "empty.gif", "grey.gif", "ajax-loader", "grey-pixel", "white-pixel"]
LAZY_ATTRIBUTES = ["data-src", "data-original", "data-lazy-src", "data-actualsrc", "data-url", "data-img", "data-pic", "data-bg", "data-background"]
BLOCK_SIGNATURES = [
    "cloudflare", "turnstile", "just a moment", "challenge-platform", "cf-browser-verify", "__cf_chl", "cf-chl", "datadome", "akamai", "incapsula", "imperva", "distil", "access denied", "request blocked",
    "your request", "please enable javascript", "browser check", "请完成安全验证", "正在进行人机验证", "滑块验证", "请稍后重试", "检测到异常访问", "请开启 JavaScript", "安全检测中", "captcha", "recaptcha", "hcaptcha", "geetest",
]
STRONG_BLOCK_SIGNATURES = ["turnstile", "challenge-platform", "cf-browser-verify", "datadome", "geetest", "请完成安全验证"]
BLOCKED_MESSAGE = "高级反爬爬不了"
CAPTCHA_WORDS = ["captcha", "verify", "验证码", "人机验证", "slider", "geetest", "recaptcha", "hcaptcha", "imgcode", "security code", "turnstile"]
PROTECTION_SIGNALS = ["cloudflare", "cf-", "__cf", "challenge", "ddos", "browser-check", "turnstile", "datadome", "akamai", "incapsula", "just a moment", "attention required", "please wait", "access denied", "请稍候", "正在检查", "安全验证", "抱歉，请稍候", "blocked", "request blocked", "your request"]
SITE_SIGNATURES = {
    "cms": ["wordpress", "wp-content", "wp-json", "joomla", "drupal", "dedecms", "帝国", "powered by"],
    "spa": ["react", "vue", "angular", "__next", "nuxt", "webpack", 'id="app"', 'id="root"', "create-react-app"],
    "ecommerce": ["shop", "cart", "product", "price", "buy", "购买", "加入购物车", "商品", "shopify", "woocommerce"],
    "blog": ["blog", "post", "article", "archives", "tag"],
    "portal": ["portal", "category", "频道", "栏目", "专题"],
}
SHOP_HOSTS = ["shop", "store", "buy", "mall"]
SCRIPT_APP_SIGNALS = ['<div id="app"', '<div id="root"', "vue", "react", "angular", "webpack", "__next"]
LIST_TITLE_WORDS = ["列表", "list", "目录", "category", "归档", "archive", "search", "搜索结果"]
PAGER_CLASS = r"(?i)(pagination|pager|page[-_]?(status|index|pre|next|last|num|bar|nav|navigation|numbar|number)|fenye|feny|turnpage)"
PAGER_TEXT = r"(共\s*\d+\s*条|共\s*\d+\s*页|当前\s*\d+\s*/\s*\d+\s*页|第\s*\d+\s*/\s*\d+\s*页)"
NOISE_PATTERNS = [
    r"电话[：:\s]*[\d\-]{7,}", r"(服务|投诉|客服|咨询)\s*(热线|电话)[：:\s]*[\d\-]{3,}", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(?i)E-mail|邮箱", r"地址[：:\s]*.{0,40}(路|街|号|厦|广场|区|楼|层|室|座)",
    r"(?i)版权所有|Copyright|All\s+Rights\s+Reserved", r"ICP备|备案号|公网安备|ICP证", r"官方微信|微信公众号|扫一扫|扫码|二维码", r"手机网站|手机版|移动版", r"技术支持", r"传真[：:\s]*[\d\-]", r"邮\s*编[：:\s]*\d{6}", r"服务热线|投诉电话",
]
NOISE_BLOCK = r"(?i)(footer|copyright|contact|bottom-info|foot|beian|banquan|sidebar_info|contact_us|left_list|left_nav)"
SAFE_BLOCK = r"(?i)(content|article|post|detail|main-text|entry|body-text|text-content|news)"
WAF_WORDS = ["just a moment", "checking your browser", "cf-browser-verification", "cloudflare", "captcha", "recaptcha", "hcaptcha", "verify you are human", "access denied", "ray id", "attention required", "please enable javascript", "ddos protection", "blocked"]
BAD_TITLES = ["just a moment", "error", "captcha", "attention", "blocked", "access denied", "challenge"]
BLOCKED_DOMAINS = [".gov", ".gov.cn", ".mil", ".edu", ".edu.cn", ".ac.cn"]
BLOCKED_DOMAIN_WORDS = ["police", "court", "hospital", "bank", "military", "gov.", ".gov", "army", "navy", "fbi", "cia"]
ANTI_CRAWL_TYPES = ["cloudflare", "waf", "captcha", "403", "access denied", "blocked", "challenge", "ddos protection", "503"]
ERROR_MESSAGES = {
    "404": "❌ [页面丢失] 目标网站页面不存在(404)，请检查网址是否正确，已跳过。",
    "timeout": "⏳ [连接超时] 无法连接到目标服务器，可能是网站已关闭或网络受限，已跳过。",
    "connectionerror": "⏳ [连接超时] 无法连接到目标服务器，可能是网站已关闭或网络受限，已跳过。",
    "connectionrefused": "⏳ [连接超时] 无法连接到目标服务器，可能是网站已关闭或网络受限，已跳过。",
    "sslerror": "🔒 [安全警告] 目标网站SSL证书无效，存在安全隐患，已跳过。",
    "certificate": "🔒 [安全警告] 目标网站SSL证书无效，存在安全隐患，已跳过。",
    "ssl": "🔒 [安全警告] 目标网站SSL证书无效，存在安全隐患，已跳过。",
}

# --- Fixed values: fields, images, categories ---
HOME_NAMES = ["首页", "主页", "Home", "home", "网站首页"]
BREADCRUMB_CLASSES = ["breadcrumb", "bread", "path", "location"]
CRUMB_CLASS = r"(?i)breadcrumb|bread_crumb|crumbs|location|position|site-nav|path-nav|nav-path|weizhi"
CRUMB_ID = r"(?i)(breadcrumb|position|location)"
TITLE_CLASS = r"(?i)article-title|post-title|news-title|detail-title"
TIME_CLASS = r"(?i)time|date|publish|pubtime|post-time|article-time"
DATE_PATTERNS = [r"(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?\s*\d{1,2}:\d{2}(?::\d{2})?)", r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})"]
ICON_WORDS = ["icon", "logo", "avatar", "banner-ad", "pixel", "tracking", "spacer", "blank", "dot", "bullet", "arrow", "favicon", "btn", "button", "qr-code", "qrcode", "erweima", "二维码", "wechat", "badge", "cert", "ico.jpg", "ico.jpeg", "ico.png", "ico.gif", "ico.bmp", "ico_", "_ico", "/ico/", "/icons/"]
PIXEL_WORDS = ["1x1", "pixel", "blank.gif", "spacer.gif"]
IMAGE_BLOCK_WORDS = ["logo", "icon", "qrcode", "erweima", "二维码", "wechat", "avatar", "favicon"]
IMAGE_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".bmp": "image/bmp", ".ico": "image/x-icon", ".avif": "image/avif"}
COMPANY_HOSTS = {"lywpower": "龙源电力", "longyuan": "龙源电力", "clypg": "龙源电力", "chnenergy": "国家能源集团", "ceic": "国家能源集团", "huinenggroup": "汇能集团", "huineng": "汇能集团"}
HOME_CATEGORY, OTHER_CATEGORY, NO_NAME = "首页", "其他页面", "未命名"
CSV_A = ["id", "sys_platform", "uuid", "bstudio_create_time", "gsmc", "ywlx1", "ywlx2", "ywlx3", "ywlx4", "url", "timestamp", "riqi", "title", "html", "zdr", "download_link", "img_url", "img_title"]
CSV_B = ["sys_platfuuid", "brwidcl_cpmc", "ywlx", "ywlx1", "ywlx2", "ywlx3", "ywlx4", "tianextimejsj", "title", "html", "download_img_url", "img_title"]
