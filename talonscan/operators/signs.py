"""What the pattern kernel knows about files: signs in their text and path, and the rules that such signs silence.

A condition is alternatives of conjunctions of signs, ``a b | !c`` for "a and b, or not c". Rule ids are those of the packs that users
load; a name that ends with ``*`` stands for all ids that begin so.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from talonscan.functions.patterns import java_regex

#: Signs of a text; any of the patterns (ECMAScript, flags) makes the sign.
CONTENT = {
    "auth_guard": [
        (r"(?:const|let)\s+\w+\s*=\s*await\s+\w+\s*\([^)]*\)\s*;?\s*\n\s*if\s*\(\s*!\w+", ""),
        (r"await\s+(?:\w+\.)*\w*(?:auth|session|permission|guard|verify|protect|check|ensure|require|assert|authorize)\w*\s*\(", "i"),
        (r"(?:function\s+(?:require|auth|protect|verify|guard|ensure|check|assert|authorize)\w*\s*\(\s*req\b|(?:const|let)\s+(?:require|auth|protect|verify|guard|ensure|check|assert|authorize)\w*\s*=\s*(?:async\s+)?\(\s*req\b)", "i"),
        (r"(?:app|router)\.(?:get|post|put|delete|patch|all|use)\s*\([^,)]+,\s*(?:require|auth|protect|verify|guard|ensure|check|assert|authorize|isAuthenticated|isLoggedIn|hasPermission)\w*\s*[,\)]", "i"),
    ],
    "destructured_await": [(r"(?:const|let)\s+\{[^}]*\}\s*=\s*await\s+\w+\s*\([^)]*\)\s*;?\s*\n\s*if\s*\(\s*!?\w+", "")],
    "early_exit": [(r"if\s*\([^)]*\)\s*(?:return|throw)\b", "")],
    "role_check": [
        (r"(?:role|permission|isAdmin|access|level)\s*(?:===|!==|==|!=)\s*[\"']", "i"),
        (r"(?:check|require|verify|ensure|assert|has|can)\w*\s*\(\s*[\"'](?:admin|manager|editor|owner|moderator|superadmin)", "i"),
        (r"\brole\b[\s\S]{0,100}?(?:!==|===)\s*[\"']", "i"),
        (r"await\s+(?:\w+\.)*\w*(?:Admin|admin)\w*\s*\([^)]*\)\s*;?\s*\n\s*if\s*\(", "i"),
    ],
    "role_import": [(r"import\s+.*(?:requireAdmin|requireRole|checkAdmin|isAdmin|verifyAdmin|assertAdmin)\b", "i")],
    "role_call": [(r"(?:requireAdmin|requireRole|checkAdmin|isAdmin|verifyAdmin|assertAdmin)\s*\(", "i")],
    "sanitized": [
        (r"(?:DOMPurify\.sanitize|sanitize(?:Html|HTML)|xss\s*\(|purify\s*\(|escapeHtml|sanitizeHtml)\s*\(", "i"),
        (r"import\s+.*(?:sanitize|DOMPurify|escapeHtml|purify|xss)\b", "i"),
    ],
    "url_checked": [
        (r"(?:(?:validate|verify|check|safe|allowed)(?:Url|URL|Uri|URI|Fetch)(?:Url)?|(?:ALLOWED_(?:HOSTS|URLS|ORIGINS|DOMAINS))|(?:allowlist|whitelist|safelist)[\s\S]{0,50}?(?:includes|has|match))", "i"),
        (r"import\s+.*(?:validateUrl|validateFetchUrl|urlValidat|safeUrl|allowedUrl)", "i"),
    ],
    "uuid_name": [
        (r"(?:randomUUID|nanoid|uuidv4|v4\s*\(\)|crypto\.randomUUID)\s*\(", "i"),
        (r"import\s+.*(?:sanitizeFilename|sanitizeUploadFilename|safeFilename)", "i"),
    ],
    "clean_name": [
        (r"(?:\.replace\s*\(\s*\/\[?\^?[a-z0-9\\\-_\]]*\]?\/?[gi]*\s*,|sanitize(?:File|Name|Path)|safeName|cleanName)", "i"),
        (r"(?:Date\.now\(\)|timestamp|uuid|nanoid|crypto\.randomUUID)[\s\S]{0,80}?\.\s*(?:ext|split|pop)", "i"),
    ],
    "cron_checked": [
        (r"(?:verify|validate|check)(?:Cron|Secret|Auth|Signature)\s*\(", "i"),
        (r"import\s+.*(?:verifyCron|cronAuth|validateCron|checkCron)", "i"),
    ],
    "redirect_checked": [
        (r"(?:sanitize|validate|verify|check|safe|allowed)(?:Redirect|RedirectUrl|CallbackUrl)\s*\(", "i"),
        (r"import\s+.*(?:sanitizeRedirect|validateRedirect|safeRedirect)", "i"),
    ],
    "react_native": [(r"(?:react-native|from\s+['\"]react-native['\"]|from\s+['\"]expo|import\s+.*\bexpo\b)", "i")],
    "timing_safe": [(r"(?:timingSafeEqual|timing.?safe|constant.?time)", "i")],
    "supabase": [(r"\bsupabase\b|createClient\s*\(|from\s+[\"']@supabase", "i")],
    "server_action": [(r"\A[\s\S]{0,499}?^\s*['\"]use server['\"];?\s*$", "m")],
    "client_component": [(r"\A[\s\S]{0,999}?^\s*['\"]use client['\"];?\s*$", "m")],
    "client_first": [(r"\A\s*['\"]use client['\"]", "")],
    "expo_import": [(r"(?:from\s+['\"]expo[\w-]*['\"]|require\s*\(\s*['\"]expo[\w-]*['\"])", "i")],
    "global_limit": [
        (r"(?:app|router)\.use\s*\(\s*(?:[^,)]*,\s*)?(?:rateLimit|slowDown|expressRateLimit|expressSlowDown|RateLimit|Throttle|throttle)\s*\(", "i"),
        (r"(?:app|router)\.use\s*\(\s*(?:[^,)]*,\s*)?\w*(?:[Ll]imiter|[Tt]hrottle|[Rr]ate[Ll]imit|[Ss]low[Dd]own|[Bb]rute)\w*\s*\)", ""),
    ],
    "limiter": [(r"\b(?:createRateLimiter|createRedisRateLimiter|createSlidingWindow|Ratelimit\.slidingWindow|express-rate-limit|hono-rate-limiter|@upstash\/ratelimit)\b", "")],
    "limit_call": [(r"\b\w+\s*\.\s*(?:check|limit)\s*\(", "")],
    "schema_library": [(r"\b(?:z\.\w+|zod\.\w+|joi\.\w+|Joi\.\w+|yup\.\w+|valibot)", "")],
    "schema_parse": [(r"\.\s*(?:parse|safeParse|validate|validateSync|parseAsync)\s*\(", "")],
    "webhook_verified": [
        (r"\b(?:stripe\.webhooks\.constructEvent|svix\.verify|\w*\.\s*verify\s*\([^)]*signature|verify\w*Webhook|verifyWebhookSignature|wh\.verify)\b", ""),
        (r"crypto\.timingSafeEqual\s*\(", ""),
    ],
    "signature": [(r"(?:verify|signature|hmac|constructEvent|svix|webhookSecret|createHmac|X-Signature|stripe-signature)", "i")],
    "bearer": [(r"(?:Bearer|x-api-key|apiKey|authorization)", "i")],
    "docker_user": [(r"^USER\s+\S+", "m")],
    "docker_health": [(r"^HEALTHCHECK\s+", "m")],
    "react_hooks": [(r"\b(?:useState|useReducer|useEffect|useLayoutEffect|useRef|useMemo|useCallback|useContext|useTransition|useSyncExternalStore)\s*\(", "")],
    "static_content": [(r"(?:JSON\.stringify|themeScript|structuredData|jsonLd|schema|gtag|analytics)", "i")],
    "user_content": [(r"(?:userInput|userData|postContent|messageBody|commentHtml)", "i")],
    "fetches": [(r"fetch\s*\(\s*(?:[\"'`]|url|signedUrl)", "i")],
    "user_fetch": [(r"fetch\s*\(\s*(?:(?:req|request|params|query|body|input|data)\s*[\[.]|new\s+URL\s*\(\s*(?:req|request))", "i")],
    "outside_fetch": [(r"fetch\s*\(\s*[\"'`]https?:\/\/", "i")],
    "inside_fetch": [(r"fetch\s*\(\s*(?:[\"'`]\/api\/|signedUrl|presignedUrl|uploadUrl)", "i")],
    "jwt_library": [(r"(?:jsonwebtoken|jose|jwt\.verify|jwt\.sign|jwt\.decode)\b", "i")],
    "hmac": [(r"(?:createHmac|hmac|crypto\.subtle\.sign|crypto\.sign)", "i"), (r"import\s+.*(?:verifyToken|validateToken|checkToken|decodeToken)\b.*from\s+[\"'].*(?:token|auth|hmac)", "i")],
    "mail": [(r"(?:resend|nodemailer|sendEmail|sendMail|email\.send)", "i")],
    "url_made": [(r"(?:getPublicUrl|getSignedUrl)\s*\(", "i")],
    "file_sent": [(r"(?:createReadStream|sendFile|res\.download|\.pipe\s*\()", "i")],
    "xml_parser": [(r"(?:parseString|parseXml|xml2js|xmldom|libxmljs|XMLParser)\s*\(", "i")],
    "service_role": [(r"(?:SUPABASE_SERVICE_ROLE|service_role|serviceRole)", "i")],
    "client_made": [(r"(?:createClient|createServerClient|createBrowserClient)", "i")],
    "mobile_client": [(r"AsyncStorage|EXPO_PUBLIC_", "i")],
    "server_client": [(r"(?:SUPABASE_SERVICE_ROLE|service_role|createServerSupabaseClient|createServerClient|createService(?:Role)?Client|createAdminClient|createServiceSupabase)", "i")],
}
#: Signs of files that define rules: three ids, a pattern; the file of the guides.
RULE_ID = r"id:\s*[\"']VG\d+[\"']"
RULE_PATTERN = (r"pattern:\s*\/", "")
GUIDES_PATH = r"(?:^|/)framework-guides\.ts\z"
#: Signs of a path.
PATH = {
    "workflow_path": (r"\.github\/workflows", ""),
    "test_path": (r"(?:\.(?:[\w-]+-)?(?:spec|test|e2e|stories|cy)\.(?:ts|tsx|js|jsx|mjs|cjs)$|_test\.go$|\/__tests__\/|\/__mocks__\/|\/tests?\/|\/cypress\/|\/playwright\/|\/dockertest\/|\/testutil\/|\/testhelpers?\/|\/testfixtures?\/)", "i"),
    "config_path": (r"(?:\.config\.[cm]?[jt]sx?$|(?:^|\/)(?:vite|vitest|jest|playwright|cypress|rollup|webpack|esbuild|tsup|react-router|svelte|astro|nuxt|babel|tailwind|postcss|drizzle)[.-][\w.-]*\.[cm]?[jt]sx?$)", "i"),
    "route_path": (r"(?:\/api\/|\/route\.(?:ts|tsx|js|jsx)$|\/pages\/api\/|\/app\/api\/)", ""),
    "static_helper_path": (r"(?:getStaticProps|getStaticPaths|generateStaticParams|buildLegacy|getServerSideProps)", ""),
    "vercel_path": (r"(?:^|\/)vercel\.json$", ""),
    "demo_path": (r"\/(?:playground|demos?|examples?|sandbox)\/", "i"),
    "expo_config_path": (r"(?:^|\/)app\.(?:json|config\.(?:js|ts|mjs|cjs))$", ""),
    "webhook_path": (r"webhook", "i"),
    "cron_path": (r"(?:cron|scheduled|jobs?)\/", "i"),
    "admin_path": (r"\/admin\/", "i"),
    "batch_path": (r"\/(?:scripts?|migrations?|seeds?|fixtures?|benchmarks?)\/", "i"),
    "template_path": (r"\/(?:templates?|scaffolds?|stubs?|boilerplate)\/", "i"),
    "public_path": (r"(?:\/api\/public\/|\/health|\/config|\/recache|\/warmup|\/ping|\/status)", "i"),
    "next_route_path": (r"(?:\/route\.(?:ts|tsx|js|jsx)$|\/pages\/api\/)", "i"),
    "bulk_path": (r"\/bulk-[\w-]+\.(?:ts|tsx|js|jsx)$", "i"),
    "manifest_path": (r"package\.json$", ""),
    "migration_path": (r"(?:\/(?:migrations?|migrate|drizzle|seeds?|fixtures)\/|supabase\/migrations\/)", "i"),
    "schema_path": (r"(?:schema|migration|seed|ddl|init).*\.sql$", "i"),
    "env_path": (r"(?:^|\/)\.env(?:\.[\w.-]+)?$", ""),
    "app_path": (r"(?:^|\/)app\/", ""),
    "segment_path": (r"(?:^|\/)(?:page|layout|route|template|default|loading|error|not-found|global-error|head)\.(?:tsx?|jsx?)$", ""),
    "server_path": (r"(?:\/api\/|middleware\.|instrumentation\.|next\.config\.|\/lib\/|\/utils\/|\/tools\/|\/server\/|\/scripts\/|\/src\/(?!app\/|pages\/|components\/)|\bcli\b|\.config\.)", ""),
    "next_path": (r"(?:\/app\/|\/pages\/|next)", "i"),
    "client_path": (r"Client\.\w+$", ""),
    "lock_path": (r"(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|npm-shrinkwrap\.json)$", ""),
    "mobile_path": (r"(?:react.native|expo|\.native\.|android|ios)", "i"),
    "rules_path": (r"(?:\/rules\/|\/data\/rules\/)", ""),
}
AUTH = "VG420 VG952 VG002 VG402"
LIMITS = "VG956 VG030 VG1004"
HTML = "VG408 VG012 VG042 VG852"
ADVISORY = r"^VG9(?:0\d|1\d|2\d|3[01])$"
#: Rules, and when a whole file is silent for them. ``path`` is the sign that the file has a path at all.
GATES = [
    ("VG21*", "path !workflow_path | !path !yaml"),
    ("VG001 VG003 VG062 VG010 VG011 VG012 VG013 VG014 VG042 VG100 VG130 VG678 VG955 VG133 VG1021 VG409 VG148 VG424 VG137 VG139", "test_path"),
    ("VG137", "config_path"),
    ("VG1005", "!supabase"),
    ("VG955", "path !route_path !server_action | static_helper_path | batch_path | cron_path | bulk_path"),
    ("VG506", "path !vercel_path"),
    ("VG041", "demo_path"),
    ("VG708", "path !expo_config_path !expo_import"),
    (LIMITS, "global_limit | limiter limit_call | cron_path | webhook_path | admin_path auth_guard"),
    ("VG1010", "schema_library schema_parse"),
    ("VG601", "webhook_verified"),
    (AUTH, "auth_guard | public_path | webhook_path signature"),
    ("VG426 VG957", "role_check"),
    ("VG1008", "auth_guard role_check | batch_path"),
    ("VG1006 VG124", "batch_path"),
    ("VG970 VG971", "template_path"),
    ("VG961", "batch_path | cron_path"),
    ("VG132", "next_route_path"),
    ("VG155", "webhook_path | cron_path | bearer"),
    ("VG863 VG864 VG865", "path !manifest_path"),
    ("VG54* VG439", "migration_path"),
    ("VG543", "migration_path | schema_path"),
    ("VG146", "path !env_path"),
    ("VG200", "docker_user"),
    ("VG206", "docker_health"),
    ("VG407", "client_component | react_hooks"),
    ("VG964", "app_path segment_path | server_path | react_native"),
    ("VG427 VG678 VG977 VG978", "react_native"),
    (HTML, "sanitized | static_content !user_content"),
    ("VG120", "url_checked | fetches !user_fetch !outside_fetch | fetches inside_fetch"),
    ("VG993", "uuid_name | clean_name"),
    ("VG106 VG159", "timing_safe"),
    ("VG968 VG503", "cron_checked"),
    ("VG425 VG409 VG660", "redirect_checked"),
    ("VG105", "!jwt_library hmac"),
    ("VG989", "next_path"),
    ("VG678", "client_first | client_path | batch_path | mail | url_made !file_sent"),
    ("VG131", "quiet_get"),
    ("VG140", "!xml_parser"),
    ("VG020 VG90* VG91* VG92* VG930 VG931", "lock_path"),
    ("VG430", "client_made service_role | react_native | mobile_client"),
    ("VG448", "server_client"),
    ("VG705 VG706 VG707 VG709", "!mobile_framework !mobile_path"),
]
#: Rules that weigh less in some files: rules, sign, severity it applies to (all if None), new severity.
MILDER = [("VG955", "admin_path auth_guard", "medium", "low"), ("VG420 VG952", "cron_path", None, "low")]
GET_HANDLER = r"export\s+(?:async\s+)?function\s+GET\s*\([^)]*\)\s*\{"
MUTATION = r"(?i)(?:\.create\s*\(|\.update\s*\(|\.delete\s*\(|\.destroy\s*\(|\.remove\s*\(|\.insert\s*\(|\.upsert\s*\(|DELETE\s+FROM|UPDATE\s+\w|INSERT\s+INTO)"


def names(condition: str) -> set[str]:
    return {w.lstrip("!") for w in condition.replace("|", " ").split()}


def braced(text: Column) -> Column:
    """The text up to the brace that closes one open before it, or all of it."""
    steps = F.filter(F.split(text, r"(?<=[{}])"), lambda s: s != "")
    state = F.aggregate(
        steps,
        F.struct(F.lit(1).alias("depth"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(a["depth"] <= 0, a).otherwise(
            F.struct((a["depth"] + F.when(s.endswith("{"), 1).when(s.endswith("}"), -1).otherwise(0)).alias("depth"), (a["at"] + F.length(s)).alias("at"))
        ),
    )
    return F.substring(text, F.lit(1), state["at"].cast("int"))


def quiet_get(content: Column) -> Column:
    """True where a GET handler is defined and its body changes nothing."""
    rest = F.get(F.split(content, GET_HANDLER, 2), 1)
    return rest.isNotNull() & ~braced(rest).rlike(MUTATION)


def signs(wanted: set[str], auth_functions: list[str] = ()) -> dict[str, Column]:
    """Boolean columns over (content, path, language, framework) for the wanted signs; a null path has no sign of its own."""
    content, path = F.col("content"), F.col("path")
    hit = lambda name: reduce(or_, [content.rlike(java_regex(p, f)) for p, f in CONTENT[name]])
    made = {
        "path": lambda: path.isNotNull(),
        "yaml": lambda: F.col("language") == "yaml",
        "mobile_framework": lambda: F.col("framework").isin("react-native", "expo"),
        "quiet_get": lambda: quiet_get(content),
        "auth_guard": lambda: reduce(or_, [hit("auth_guard"), hit("destructured_await") & hit("early_exit"), *[content.rlike(rf"(?i){f}\s*\(") for f in auth_functions]]),
        "role_check": lambda: hit("role_check") | (hit("role_import") & hit("role_call")),
    }
    out = {}
    for name in sorted(wanted):
        found = made[name]() if name in made else hit(name) if name in CONTENT else path.rlike(java_regex(*PATH[name]))
        out[name] = F.coalesce(found, F.lit(False))
    return out


def holds(condition: str, of) -> Column:
    """The condition over signs; ``of`` gives a sign's column."""
    one = lambda word: ~of(word[1:]) if word.startswith("!") else of(word)
    return reduce(or_, [reduce(and_, [one(w) for w in part.split()]) for part in condition.split("|")])


def advisory():
    """A test for ids of rules that comments and strings do not silence."""
    return re.compile(ADVISORY).match


def covers(rules: str, rule_id: str) -> bool:
    return any(rule_id.startswith(r[:-1]) if r.endswith("*") else rule_id == r for r in rules.split())


def silent_when(rule_id: str) -> str | None:
    """The condition under which a file is silent for a rule."""
    return " | ".join(c for rules, c in GATES if covers(rules, rule_id)) or None
