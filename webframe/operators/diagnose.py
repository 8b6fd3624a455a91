"""Why a page gave nothing: blocked, login-only, challenged, empty, or fine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions import text as T
from webframe.functions.common import let
from webframe.functions.matching import found, prepared
from webframe.functions.urls import url_changed
from webframe.operators import selectors as S

# What pages say, the kind of problem it speaks for, and its weight.
KEYWORDS = (
    (r"没有权限|无权限|无权访问|权限不足|没有访问权限", "no_permission", "permission_denied", 0.75),
    (r"permission\s+denied|access\s+denied|not\s+authorized|unauthorized", "no_permission_en", "permission_denied", 0.7),
    (r"仅(?:管理员|版主|内部人员|特定用户)|只有?.*才(?:能|可)查看", "role_only", "permission_denied", 0.6),
    (r"未(?:被)?授权|没有授权", "not_granted", "permission_denied", 0.6),
    (r"请先?登录|需要登录|未登录|登录后(?:才能)?(?:查看|访问|继续)", "login_needed", "login_required", 0.7),
    (r"登录已?过期|会话过期|重新登录|请重新登录", "login_expired", "login_required", 0.7),
    (r"please\s+(?:log|sign)\s?in|login\s+required", "login_needed_en", "login_required", 0.6),
    (r"访问(?:过于)?频繁|操作(?:过于)?频繁|请稍后再试|请求过于频繁", "too_frequent", "rate_limited", 0.7),
    (r"风控|风险(?:控制|提示)|异常(?:访问|请求|流量)|检测到(?:异常|风险)", "risk_control", "risk_control", 0.75),
    (r"人机验证|安全验证|滑动验证|拖动滑块|请完成验证|验证你是|完成验证", "human_check", "captcha", 0.7),
    (r"verify\s+you\s+are\s+human|are\s+you\s+a\s+robot|unusual\s+traffic|checking\s+your\s+browser", "human_check_en", "captcha", 0.7),
    (r"cf-browser-verification|cf_chl_|challenge-platform|just\s+a\s+moment", "edge_challenge", "risk_control", 0.7),
    (r"您的?(?:IP|ip)(?:地址)?(?:已被)?(?:封禁|限制|禁止)", "ip_banned", "risk_control", 0.8),
    (
        r"未能找到相关搜索结果|没有找到相关(?:结果|内容)|未找到相关(?:结果|内容)|无相关(?:结果|内容)|搜索结果为空",
        "empty_result", "rate_limited", 0.7,
    ),
    (r"no\s+results?\s+found|nothing\s+found|your\s+search.*did\s+not\s+match", "empty_result_en", "rate_limited", 0.6),
    (r"(?:access|request)?\s*blocked|已被?拦截|拦截了你的请求", "request_blocked", "risk_control", 0.7),
    (r"地区(?:限制|不支持)|仅限(?:中国大陆|境内)访问|not\s+available\s+in\s+your\s+region", "region", "risk_control", 0.6),
    (r"服务(?:器)?(?:错误|异常|不可用)|内部错误|系统(?:繁忙|错误)|稍后重试", "server_text", "server_error", 0.5),
    (
        r"\b(?:http\s*)?5\d{2}\s*(?:internal\s+server\s+error|server\s+error|error|错误|异常)"
        r"|\bhttp\s+5\d{2}\b|bad\s+gateway|service\s+(?:unavailable|temporarily\s+unavailable)"
        r"|internal\s+server\s+error|网关错误|服务器内部错误",
        "server_5xx", "server_error", 0.6,
    ),
    (r"找不到(?:页面|该页)|页面不存在|not\s+found", "missing_page", "not_found", 0.5),
    (r"出错啦|出错了|发生错误|页面异常|something\s+went\s+wrong|an\s+error\s+occurred", "generic_error", "unknown", 0.3),
    (r"需要(?:报名|加入|申请)|先(?:报名|加入)才(?:能|可)", "join_first", "permission_denied", 0.55),
)
LOGIN_URL_HINTS = ("/login", "/signin", "/sign-in", "/logon", "/auth", "/sso", "/passport", "/session/new")
BLOCKING = ("permission_denied", "login_required", "risk_control", "captcha", "rate_limited", "server_error", "not_found")
DETECT_AT = 0.5

# Block-page patterns.
BLOCK_PATTERNS = (
    (r"访问(过于)?频繁|请稍后再试|操作太频繁", "too_frequent"),
    (r"人机验证|安全验证|滑动验证|拖动滑块|请完成验证", "human_check"),
    (r"verify you are human|are you a robot|unusual traffic", "human_check_en"),
    (r"access denied|forbidden|请求被拒绝", "denied"),
    (r"cf-browser-verification|cf_chl_|challenge-platform", "edge_challenge"),
    (r"captcha|recaptcha|hcaptcha|geetest", "captcha_widget"),
    (r"您的访问速度过快|blocked by|security check", "security_block"),
)

# Weights of the login signals.
ANON_WEIGHTS = {"login_prompt": 0.45, "login_links": 0.25, "password_input": 0.30, "auth_form": 0.25}
AUTH_WEIGHTS = {"logout": 0.55, "avatar": 0.30, "own_nav": 0.30, "account_prompt": 0.25, "account_path": 0.35}
LOGIN_THRESHOLD, LOGIN_GAP = 0.4, 0.05
ACCOUNT_PATHS = (
    "/logout", "/stacc", "/dashboard", "/history.php", "/bookmark.php", "/novel/marker_all", "/manage/requests",
    "/group/group_list", "/settings", "/mypage",
)
OWN_NAV_HREFS = (
    "/bookmark", "/mypage", "/my/", "/settings", "/following", "/history", "/dashboard", "/stacc", "/marker_all",
    "/manage/", "/group/group_list", "/novel/marker",
)
OWN_NAV_WORDS = (
    r"(?i)(我的|個人|个人|收藏|关注|追蹤|消息|通知|设置|設定|书签|浏览记录|动态|约稿|参加群组|作品管理|创作|マイページ|ブックマーク|"
    r"フォロー|フォロワー|設定|通知|メッセージ|履歴|マンガ|小説|마이페이지|북마크|팔로우|설정|알림|"
    r"bookmark|favorite|following|setting|notification|mypage)"
)
LOGIN_LINK_TEXT = r"(?i)^(登录|登陆|注册|立即登录|免费注册|sign\s?in|log\s?in|sign\s?up|register)$"
LOGIN_LINK_HREF = r"(?i)(^|/)(login|signin|register|signup)(/|$|\?)|accounts\."
AUTH_FORM_ACTION = r"(?i)login|signin|auth|accounts\."
LOGOUT = r"(?i)退出|登出|注销|ログアウト|로그아웃|log\s?out|sign\s?out|/logout"
LOGIN_PROMPT = (
    r"(?i)请先?登录|需要登录|登录后(才能)?|用\s*\S*\s*账号登录|注册账号|立即注册|免费注册|未登录|ログイン(する|してください)|新規登録|"
    r"(log\s?in|sign\s?in)\s+(with|to|required)|please\s+(log\s?in|sign\s?in)|create\s+an?\s+account|sign\s?up\s+(for\s+)?free"
)
ACCOUNT_PROMPT = (
    r"(?i)我的(主页|收藏|关注|账号|消息)|个人中心|账号设置|退出登录|我的作品|マイページ|ブックマーク|フォロー中|ログアウト|"
    r"\bmy\s+(bookmarks|favorites|follow|account|profile|works|page)\b|log\s?out|sign\s?out"
)

# Challenge evidence and vendors.
CHALLENGE_FRAME = r"(?i)bframe|hcaptcha|turnstile|captcha/challenge|geetest"
CHALLENGE_SRC = r"(?i)recaptcha|hcaptcha|turnstile|captcha|challenge|geetest|arkose|funcaptcha"
CHALLENGE_TEXT = (
    r"(?i)verify you are human|确认您是真人|请(完成|通过)验证|滑动(验证|滑块)|人机验证|安全验证|不是机器人|i'?m not a robot|"
    r"checking your browser|just a moment|正在验证|请稍候"
)
CHALLENGE_BOX = '.g-recaptcha[data-sitekey], .cf-turnstile, .h-captcha, #geetest-box, [class*="captcha-container"], [id*="captcha" i]'
VENDORS = (
    (r"(?i)recaptcha\.net|google\.com/recaptcha", "Google reCAPTCHA"),
    (r"(?i)hcaptcha\.com", "hCaptcha"),
    (r"(?i)challenges\.cloudflare\.com|turnstile", "Cloudflare Turnstile"),
    (r"(?i)geetest", "GeeTest"),
    (r"(?i)arkose|funcaptcha", "Arkose Labs"),
    (r"(?i)tcaptcha|tencent", "Tencent Captcha"),
)


def keyword_hits(text, status=None) -> Column:
    """``array<struct<label, kind, weight>>`` of the keyword rules the text meets.

    With a 2xx status the number-like 5xx rule does not count: the server did answer.
    """
    text = F.col(text) if isinstance(text, str) else text
    ok = F.coalesce((F.col(status) >= 200) & (F.col(status) < 300), F.lit(False)) if status else F.lit(False)

    def rules(s: Column) -> Column:
        out = []
        for pattern, label, kind, weight in KEYWORDS:
            hit = found(s, pattern)
            if label == "server_5xx":
                hit = hit & ~ok
            out.append(F.when(hit, F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))))
        return F.array_compact(F.array(*out))

    text = F.coalesce(text, F.lit(""))
    return let(prepared(text), rules)


def block_hits(text) -> Column:
    """Labels of the block-page patterns a text shows."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return let(
        prepared(text),
        lambda s: F.array_compact(F.array(*[F.when(found(s, p, "(?iu)"), F.lit(label)) for p, label in BLOCK_PATTERNS])),
    )


def _scores(points: Column) -> Column:
    """Points summed per kind, in order of first appearance."""
    kinds = F.array_distinct(F.transform(points, lambda p: p["kind"]))
    return F.transform(
        kinds,
        lambda k: F.struct(
            k.alias("kind"),
            F.aggregate(F.filter(points, lambda p: p["kind"] == k), F.lit(0.0), lambda a, p: a + p["weight"]).alias("score"),
        ),
    )


def _best(scores: Column) -> Column:
    """Highest score, the first one on a tie."""
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    return F.get(F.filter(scores, lambda s: s["score"] == top), F.lit(0))


def access_issue(pt: DataFrame) -> DataFrame:
    """Diagnosis per page from its text, structure, addresses and status.

    ``pt``: rows of ``page_text`` plus ``requested_url``, ``final_url``,
    ``status`` and optionally ``challenged`` (a confirmed or refuted challenge),
    all per page: one projection, no shuffle.
    """
    for name, kind in (("status", "int"), ("challenged", "boolean"), ("requested_url", "string"), ("final_url", "string")):
        if name not in pt.columns:
            pt = pt.withColumn(name, F.lit(None).cast(kind))
    point = lambda kind, weight: F.struct(F.lit(None).cast("string").alias("label"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    hay = F.concat_ws("\n", "title", "body_text", "main_text")
    change = url_changed("requested_url", "final_url")
    st = F.col("status")
    to_login = reduce(Column.__or__, [F.contains(F.lower(F.coalesce("final_url", F.lit(""))), F.lit(h)) for h in LOGIN_URL_HINTS])
    d = pt.withColumn("_kw", keyword_hits(hay, "status")).withColumn("url_change", change)
    moved = F.col("url_change.changed")
    login_forms = F.exists("forms", lambda f: f["has_password"])
    error_status = F.coalesce(st >= 400, F.lit(False))
    shell = T.looks_like_spa_shell("body_text", "interactive_count", "dom_nodes") & ~error_status
    extra = F.array_compact(
        F.array(
            F.when(F.col("password_inputs") > 0, point("login_required", 0.35)),
            F.when(login_forms, point("login_required", 0.25)),
            F.when(F.size("captcha") > 0, point("captcha", 0.3)),
            F.when(moved & to_login, point("login_required", 0.35)),
            F.when(moved & ~to_login, point("unknown", 0.15)),
            F.when(st == 401, point("permission_denied", 0.3)),
            F.when(st == 401, point("login_required", 0.15)),
            F.when(st == 403, point("permission_denied", 0.4)),
            F.when(st == 429, point("rate_limited", 0.7)),
            F.when(st == 404, point("not_found", 0.6)),
            F.when((st >= 500) & (st < 600), point("server_error", 0.7)),
            F.when(shell, point("spa_shell", 0.5)),
        )
    )
    d = d.withColumn("_points", F.concat("_kw", extra))
    d = d.withColumn("_all", _scores(F.col("_points")))
    settled = (
        F.when(
            F.col("challenged"),
            F.transform("_all", lambda s: F.struct(s["kind"].alias("kind"), F.when(s["kind"] == "captcha", F.greatest(s["score"], F.lit(0.8))).otherwise(s["score"]).alias("score"))),
        )
        .when(~F.col("challenged"), F.filter("_all", lambda s: s["kind"] != "captcha"))
        .otherwise(F.col("_all"))
    )
    d = d.withColumn("_scores", settled).withColumn("_best", _best(F.col("_scores")))
    conf = F.round(F.least(F.coalesce("_best.score", F.lit(0.0)), F.lit(1.0)), 2)
    by_score = conf >= DETECT_AT
    hard = F.coalesce(st.isin(401, 403, 429), F.lit(False)) & ~by_score
    kind = F.coalesce("_best.kind", F.when(hard, F.when(st == 429, "rate_limited").otherwise("permission_denied")), F.lit("empty_page"))
    return d.select(
        *[c for c in ("page_id", "requested_url", "final_url", "status") if c in d.columns],
        (by_score | hard).alias("detected"), kind.alias("issue_type"),
        F.when(hard, F.greatest(conf, F.lit(0.55))).otherwise(conf).alias("confidence"),
        F.transform("_kw", lambda k: k["label"]).alias("keyword_hits"),
        F.map_from_entries(F.transform("_scores", lambda s: F.struct(s["kind"], F.round(s["score"], 2)))).alias("scores"),
        F.col("url_change.changed").alias("redirected"), F.col("url_change.kind").alias("url_change"),
        F.when(by_score | hard, T.extract_codes("body_text", "title")).alias("error_codes"),
        "password_inputs", F.size("forms").alias("form_count"), F.size("captcha").alias("captcha_elements"),
        F.size("auth_links").alias("auth_link_count"),
    )


def empty_page_issue(issues: DataFrame, item_counts: DataFrame) -> DataFrame:
    """Pages without rows and without another finding are ``empty_page``."""
    d = issues.join(item_counts, "page_id", "left")
    empty = (F.coalesce("n_items", F.lit(0)) == 0) & ~F.col("detected")
    return d.withColumn("issue_type", F.when(empty, "empty_page").otherwise(F.col("issue_type"))).withColumn(
        "confidence", F.when(empty, 0.0).otherwise(F.col("confidence"))
    )


def gate_blocked(pages: DataFrame, issues: DataFrame, content: DataFrame) -> DataFrame:
    """Which pages to extract: blocked ones are skipped unless they do have content."""
    d = pages.join(issues.select("page_id", "detected", "issue_type"), "page_id", "left").join(content, "page_id", "left")
    blocked = F.coalesce(F.col("detected") & F.col("issue_type").isin(*BLOCKING), F.lit(False))
    has = F.coalesce("has_content", F.lit(False))
    return d.withColumn("extract", ~blocked | has).withColumn(
        "reason",
        F.when(blocked & ~has, F.concat(F.lit("skipped: "), "issue_type")).when(blocked, F.concat(F.lit("continued despite: "), "issue_type")),
    )


def login_signals(nodes: DataFrame, pt: DataFrame) -> DataFrame:
    """Login signals of every page from its element rows and texts."""
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    tag, t, href = F.col("tag"), F.trim("text"), attr("href")
    shown = ~F.col("hidden")
    chrome = F.col("path").rlike(r"(?i)(^|/)(header|nav)[#.:]|\.[^/]*header[^/]*")
    link = (tag == "a") & F.map_contains_key("attrs", "href")
    around = lambda words: F.lower("path").rlike(words)
    src = F.lower(attr("src"))
    square = F.abs(attr("width").try_cast("int") - attr("height").try_cast("int")) <= 8
    sized = F.coalesce(square & attr("width").try_cast("int").between(24, 96), F.lit(False))
    avatar = (tag == "img") & shown & chrome & (src != "") & ~src.startswith("data:") & (
        around(r"avatar|user-?icon|user-?menu|account-?menu") | src.rlike("profile|avatar") | sized
    )
    own = link & shown & chrome & (
        ((F.length(t) > 0) & (F.length(t) <= 12) & t.rlike(OWN_NAV_WORDS)) | reduce(Column.__or__, [href.contains(h) for h in OWN_NAV_HREFS])
    )
    invisible = attr("style").rlike(r"(?i)visibility\s*:\s*hidden|opacity\s*:\s*0(?![.\d])")
    account = link & ~invisible & reduce(Column.__or__, [href.contains(p) for p in ACCOUNT_PATHS])
    login = link & shown & (F.length(t) > 0) & (F.length(t) <= 40) & (t.rlike(LOGIN_LINK_TEXT) | href.rlike(LOGIN_LINK_HREF))
    counts = nodes.groupBy("page_id").agg(
        F.count_if(login).alias("login_link_count"),
        F.count_if((tag == "form") & attr("action").rlike(AUTH_FORM_ACTION)).alias("auth_form_count"),
        F.count_if((tag == "input") & (F.lower(attr("type")) == "password") & shown).alias("password_count"),
        F.count_if(tag.isin("a", "button") & ~invisible & F.concat_ws(" ", t, href).rlike(LOGOUT)).alias("logout_count"),
        F.count_if(avatar).alias("avatar_count"), F.count_if(own).alias("own_nav_count"),
        F.count_if(account).alias("account_path_count"),
    )
    return counts.join(pt.select("page_id", "body_text"), "page_id").select(
        "page_id", F.col("body_text").rlike(LOGIN_PROMPT).alias("login_prompt"),
        (F.col("login_link_count") > 0).alias("login_links"), (F.col("password_count") > 0).alias("password_input"),
        (F.col("auth_form_count") > 0).alias("auth_form"), (F.col("logout_count") > 0).alias("logout"),
        (F.col("avatar_count") > 0).alias("avatar"), (F.col("own_nav_count") > 0).alias("own_nav"),
        F.col("body_text").rlike(ACCOUNT_PROMPT).alias("account_prompt"),
        (F.col("account_path_count") > 0).alias("account_path"), "auth_form_count",
    )


def login_state(signals: DataFrame) -> DataFrame:
    """logged_in, anonymous or unknown, from weighted signals for and against."""
    total = lambda ws: reduce(Column.__add__, [F.when(F.col(k), F.lit(w)).otherwise(0.0) for k, w in ws.items()])
    d = signals.withColumn("auth_score", total(AUTH_WEIGHTS)).withColumn("_a", total(ANON_WEIGHTS))
    none = F.col("auth_score") == 0
    anon = F.col("_a") + F.when(none & (F.col("_a") > 0), 0.15).otherwise(0.0) + F.when(none & (F.col("auth_form_count") >= 2), 0.35).otherwise(0.0)
    d = d.withColumn("anon_score", F.round(anon, 4)).withColumn("auth_score", F.round("auth_score", 4))
    net = F.round(F.col("auth_score") - F.col("anon_score"), 4)
    state = (
        F.when((F.col("auth_score") >= LOGIN_THRESHOLD) & (net > LOGIN_GAP), "logged_in")
        .when((F.col("anon_score") >= LOGIN_THRESHOLD) & (net < -LOGIN_GAP), "anonymous")
        .otherwise("unknown")
    )
    top = F.when(state == "logged_in", F.col("auth_score")).when(state == "anonymous", F.col("anon_score")).otherwise(F.greatest("auth_score", "anon_score"))
    return d.select("page_id", state.alias("state"), F.round(F.least(top, F.lit(1.0)), 2).alias("confidence"), "anon_score", "auth_score")


def challenge_signals(nodes: DataFrame, pt: DataFrame) -> DataFrame:
    """Challenge evidence per page; frame size is taken from its attributes where given."""
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    src, shown = attr("src"), ~F.col("hidden")
    size_ok = (F.coalesce(attr("width").try_cast("int"), F.lit(100)) >= 100) & (F.coalesce(attr("height").try_cast("int"), F.lit(60)) >= 60)
    frame = (F.col("tag") == "iframe") & ~attr("style").rlike(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden") & src.rlike(CHALLENGE_SRC) & src.rlike(CHALLENGE_FRAME) & size_ok
    box = shown & S.match(CHALLENGE_BOX)
    got = nodes.groupBy("page_id").agg(
        F.count_if(frame).alias("frames"), F.count_if(box).alias("boxes"),
        F.min_by(F.concat_ws(" ", src, attr("class")), F.when(frame | box, F.struct((~frame).alias("b"), F.col("node_id")))).alias("evidence"),
    )
    return got.join(pt.select("page_id", F.regexp_replace("body_text", r"\s+", " ").rlike(CHALLENGE_TEXT).alias("text_hit")), "page_id")


def challenge(signals: DataFrame) -> DataFrame:
    """Is the page asking for a human check now? Text alone never decides."""
    seen = (F.col("frames") > 0) | (F.col("boxes") > 0)
    score = F.when(F.col("frames") > 0, 0.7).otherwise(0.0) + F.when(F.col("boxes") > 0, 0.5).otherwise(0.0) + F.when(F.col("text_hit"), 0.35).otherwise(0.0)
    kind = F.when(F.col("evidence").rlike(VENDORS[0][0]), VENDORS[0][1])
    for pattern, name in VENDORS[1:]:
        kind = kind.when(F.col("evidence").rlike(pattern), name)
    conf = F.round(F.least(score, F.lit(1.0)), 2)
    return signals.select("page_id", (seen & (conf >= DETECT_AT)).alias("challenged"), kind.otherwise("unknown").alias("vendor"), conf.alias("confidence"))
