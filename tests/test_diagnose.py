from pyspark.sql import functions as F

from webframe.operators import diagnose as A
from webframe.operators.report import TEXT_COLUMNS, page_text
from webframe.sources.nodes import html_nodes

CASES = {
    1: (401, "<title>Error</title><h1>出错啦</h1><div class='error-message'>没有权限请求此资源。</div><a href='/auth/login'>登录</a>", {"permission_denied"}),
    2: (200, "<title>用户登录</title><h1>请先登录</h1><form action='/login' method='post'><input name='u'><input type='password' name='p'><button>登录</button></form>", {"login_required"}),
    3: (403, "<title>安全验证</title><div class='challenge-platform'><p>检测到异常访问, 请完成验证后继续。</p><p>cf_chl_opt</p><div class='captcha-container'></div></div>", {"risk_control", "captcha"}),
    4: (200, "<h1>访问过于频繁</h1><p>您的请求过于频繁, 请稍后再试。</p><p>您的IP地址已被限制访问。</p>", {"rate_limited", "risk_control"}),
    5: (200, "<title>人机验证</title><h1>请完成验证</h1><p>拖动滑块</p><iframe src='/recaptcha/api.js'></iframe><div id='geetest-box' class='geetest_panel'></div>", {"captcha"}),
    6: (200, "<h1>全部商品</h1>" + "<article class='product'><h3>商品</h3><span class='price'>¥45.00</span></article>" * 5 + "<nav><a href='/login'>登录</a><a href='/about'>关于</a></nav>", None),
    7: (200, "<title>App</title><div id='root'></div><script src='/app.js'></script>", {"spa_shell"}),
    8: (502, "<title>502 Bad Gateway</title><h1>502 Bad Gateway</h1><p>服务暂时不可用, 请稍后重试。</p>", {"server_error"}),
}


def diagnosed(page, spark):
    pages = page({i: c[1] for i, c in CASES.items()}, "http://h.example.com/l")
    st = spark.createDataFrame([(i, c[0]) for i, c in CASES.items()], "page_id bigint, status int")
    nodes = html_nodes(pages, TEXT_COLUMNS).cache()
    return nodes, page_text(nodes).join(st, "page_id").cache()


def test_page_cases(page, spark):
    nodes, pt = diagnosed(page, spark)
    got = {r["page_id"]: r for r in A.access_issue(pt).collect()}
    for i, (_, _, kinds) in CASES.items():
        if kinds is None:
            assert not got[i]["detected"], got[i]
        else:
            assert got[i]["detected"] and got[i]["issue_type"] in kinds, got[i]
    assert got[2]["password_inputs"] == 1 and got[5]["captcha_elements"] >= 1
    states = {r["page_id"]: r["state"] for r in A.login_state(A.login_signals(nodes, pt)).collect()}
    assert states[2] == "anonymous" and states[7] == "unknown"
    ch = {r["page_id"]: r for r in A.challenge(A.challenge_signals(nodes, pt)).collect()}
    assert ch[5]["challenged"] and ch[5]["vendor"] == "GeeTest" and not ch[6]["challenged"]
    confirmed = A.access_issue(pt.withColumn("challenged", F.lit(False))).where("page_id = 5").first()
    assert confirmed["issue_type"] != "captcha"
    empty = A.empty_page_issue(A.access_issue(pt), spark.createDataFrame([(6, 0)], "page_id bigint, n_items bigint")).where("page_id = 6").first()
    assert empty["issue_type"] == "empty_page"


def test_redirects_and_hard_status(spark):
    none = F.array().cast("array<string>")
    base = spark.createDataFrame(
        [(1, "http://h/a", "http://h/login", 200), (2, "http://h/a", "http://o/b", 200), (3, "http://h/a", "http://h/a", 403), (4, "http://h/a", "http://h/a", 429)],
        "page_id bigint, requested_url string, final_url string, status int",
    )
    pt = base.select(
        "*", F.lit("t").alias("title"), F.lit("x" * 100).alias("body_text"), F.lit("").alias("main_text"),
        F.array().cast("array<struct<selector:string,action:string,method:string,has_password:boolean,inputs:array<string>>>").alias("forms"),
        F.lit(0).alias("password_inputs"), none.alias("captcha"), none.alias("auth_links"), F.lit(5).alias("interactive_count"), F.lit(50).alias("dom_nodes"),
    )
    got = {r["page_id"]: r for r in A.access_issue(pt).collect()}
    assert got[1]["scores"] == {"login_required": 0.35} and got[1]["redirected"]
    assert got[2]["scores"] == {"unknown": 0.15} and got[2]["url_change"] == "cross-site"
    assert (got[3]["detected"], got[3]["issue_type"], got[3]["confidence"]) == (True, "permission_denied", 0.55)
    assert (got[4]["issue_type"], got[4]["confidence"]) == ("rate_limited", 0.7)


def test_text_lists(spark):
    hit = ["500 Internal Server Error", "HTTP 502", "502 Bad Gateway", "503 Service Unavailable", "服务器内部错误", "500 错误"]
    miss = ["投稿超过 50 万件", "投稿超过 500 万件", "尺寸 500x500", "共 504 个作品", "收藏 502 次", "浏览 5031", "作品 ID 5001234"]
    empty = ["很抱歉，未能找到相关搜索结果！", "没有找到相关内容", "未找到相关结果", "无相关内容", "搜索结果为空", "No results found", "Nothing found"]
    healthy = ["东京 03:44", "晴天 04:29", "搜索结果 共 301 首单曲", "发现音乐 我的音乐 关注 商城"]
    d = spark.createDataFrame([(t,) for t in hit + miss + empty + healthy], "t string").coalesce(1)
    kinds = {r["t"]: {h["kind"] for h in r["k"]} for r in d.select("t", A.keyword_hits("t").alias("k")).collect()}
    assert all("server_error" in kinds[t] for t in hit), kinds
    assert all(not kinds[t] for t in miss + healthy), kinds
    assert all(kinds[t] == {"rate_limited"} for t in empty)
    with_ok = d.select("t", F.lit(200).alias("status")).select("t", A.keyword_hits("t", "status").alias("k")).where("t = 'HTTP 502'").first()
    assert with_ok["k"] == []


def test_gate(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id bigint")
    issues = spark.createDataFrame([(1, True, "captcha"), (2, True, "captcha"), (3, True, "spa_shell")], "page_id bigint, detected boolean, issue_type string")
    content = spark.createDataFrame([(1, False), (2, True), (3, False)], "page_id bigint, has_content boolean")
    got = {r["page_id"]: (r["extract"], r["reason"]) for r in A.gate_blocked(pages, issues, content).collect()}
    assert got == {1: (False, "skipped: captcha"), 2: (True, "continued despite: captcha"), 3: (True, None)}
