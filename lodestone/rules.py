"""Rule packs: the lexicons and markers that text rules read. Rules are data, operators are not."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RulePack:
    """Words and markers of one kind of text. Dictionary order is significant: first match wins."""

    rounds: tuple[str, ...]
    follow_ups: tuple[str, ...]
    numerals: str
    hints: tuple[str, ...]
    noise: tuple[str, ...]
    topics: dict[str, tuple[str, ...]]
    companies: dict[str, tuple[str, ...]]
    businesses: dict[str, tuple[str, ...]]
    known_hosts: tuple[str, ...]
    other_topic: str = "其他"
    unknown_company: str = "其他/未知"
    unknown: str = "待识别"
    title_suffix: str = "小红书"
    note_platform: str = "小红书"
    index_platform: str = "搜索索引"
    page_marker: tuple[str, str] = ("[图片OCR 第", "页]")
    shortest: int = 5
    longest: int = 130
    block: int = 2
    profiles: dict[str, tuple[str, str]] = field(default_factory=dict)


# Fixed values that results must share with existing libraries: words, hosts and markers, in their order.
DEFAULT = RulePack(
    rounds=("一面", "二面", "三面", "四面", "加面"),
    follow_ups=("追问",),
    numerals="一二三四五六七八九十",
    hints=(
        "什么", "为什么", "怎么", "如何", "怎样", "介绍", "解释", "区别", "比较", "推导",
        "手写", "代码", "设计", "实现", "复杂度", "原理", "优缺点", "场景", "指标", "损失",
        "是否", "哪些", "讲讲", "说说", "了解", "解决", "处理", "优化", "定义", "含义",
        "手撕", "原因", "能否", "有没有",
    ),
    noise=(
        "点赞", "收藏", "发布于", "登录", "关注", "反问环节", "反问：", "面试时间", "自我介绍",
        "基本情况", "面试官风格", "问题重合度", "复盘下来", "面试官人很好",
        "没想到", "最终是否拿offer", "不建议写在简历", "还在流程中", "总体比较轻松",
    ),
    topics={
        "项目与实验": ("项目", "论文", "实验", "baseline", "基线", "消融", "复杂度"),
        "推荐链路": ("链路", "召回", "粗排", "精排", "排序", "重排", "看板"),
        "冷启动与迁移": ("冷启动", "新用户", "新商品", "新视频", "跨域", "迁移", "长尾"),
        "序列与注意力": ("序列", "din", "dien", "gru", "caser", "attention", "qkv", "transformer", "rankmixer"),
        "多任务学习": ("多任务", "mmoe", "ple", "esmm", "pcgrad", "损失权重", "梯度冲突"),
        "排序与特征交互": ("ctr", "deepfm", "wide&deep", "特征交叉", "排序模型", "rankmixer", "fm怎样", "fm时间"),
        "指标与实验": ("auc", "roc", "pr", "gauc", "uauc", "指标", "a/b", "ab实验", "评估", "样本比例"),
        "偏差与样本": ("偏差", "不平衡", "负样本", "正负样本", "采样", "有偏", "信息茧房"),
        "LLM与生成式推荐": ("大模型", "llm", "生成式", "sft", "ppo", "prompt", "多模态", "文案", "query"),
        "机器学习基础": ("梯度下降", "优化器", "过拟合", "逻辑回归", "交叉熵", "bce", "贝叶斯", "word2vec", "fm"),
        "深度学习训练": ("梯度消失", "梯度爆炸", "初始化", "激活函数", "学习率", "batch size", "batchsize", "归一化"),
        "编程与概率": ("代码", "手写", "数组", "矩阵", "二叉树", "概率", "top k", "全排列", "子集", "动态规划"),
        "计算机网络": ("tcp", "udp", "http", "https", "网络", "拥塞", "三次握手", "四次挥手", "dns"),
        "操作系统": ("进程", "线程", "协程", "死锁", "虚拟内存", "调度", "文件系统"),
        "数据库与缓存": ("mysql", "数据库", "事务", "索引", "redis", "缓存", "一致性", "隔离级别"),
        "系统设计": ("系统设计", "高并发", "分布式", "限流", "熔断", "消息队列", "微服务", "可用性"),
        "前端与客户端": ("javascript", "typescript", "react", "vue", "浏览器", "渲染", "android", "ios"),
        "语言与运行时": ("python", "java", "c++", "golang", "rust", "垃圾回收", "jvm", "并发"),
        "行为与协作": ("冲突", "协作", "压力", "规划", "职业", "离职", "优点", "缺点"),
    },
    companies={
        "字节跳动": ("字节", "抖音", "tiktok"),
        "阿里巴巴": ("阿里", "淘宝", "淘天", "阿里妈妈", "高德", "饿了么"),
        "腾讯": ("腾讯", "微信", "wxg", "pcg", "cdg", "ieg"),
        "美团": ("美团", "mtgr"),
        "快手": ("快手",),
        "百度": ("百度", "凤巢"),
        "京东": ("京东", "京东零售", "jdy"),
        "拼多多": ("拼多多", "pdd", "temu"),
        "滴滴": ("滴滴",),
        "小红书": ("小红书",),
        "网易": ("网易",),
        "华为": ("华为",),
        "小米": ("小米",),
        "携程": ("携程",),
        "哔哩哔哩": ("哔哩哔哩", "b站", "bilibili"),
        "Shopee": ("shopee",),
        "SHEIN": ("shein",),
        "蘑菇街": ("蘑菇街",),
        "蚂蚁集团": ("蚂蚁",),
    },
    businesses={
        "广告": ("广告", "ctr", "cvr", "ocpc", "ocpm", "pacing", "拍卖"),
        "搜索": ("搜索", "搜推", "query", "相关性", "learning to rank"),
        "推荐": ("推荐", "召回", "精排", "粗排", "重排", "feed"),
        "TTS": ("tts", "语音合成", "speech synthesis"),
    },
    known_hosts=("xiaohongshu.com", "nowcoder.com", "zhihu.com", "weixin.qq.com"),
    profiles={"nowcoder": ("nowcoder", "牛客"), "zhihu": ("zhihu", "知乎"), "weixin": ("weixin", "微信公众号")},
)

#: A test lexicon of words that occur in Latin-script tables; it carries no meaning beyond that.
LATIN = RulePack(
    rounds=("Part", "Teil"),
    follow_ups=("Next",),
    numerals="IVX",
    hints=("license", "with", "that", "nicht", "que", "pour", "les"),
    noise=("idiot", "$$$", " | "),
    topics={
        "law": ("license", "apache", "permission", "copyright"),
        "english": ("the", "with", "that", "this", "from"),
        "german": ("der", "und", "nicht", "mit", "ein"),
        "french": ("les", "des", "pour", "dans", "est"),
        "spanish": ("los", "que", "una", "con", "por"),
    },
    companies={"Apache": ("apache", "license"), "Thing": ("thing", "ther"), "Verein": ("verein", "schaft"), "Maison": ("maison", "eau"), "Casa": ("casa", "ción")},
    businesses={"legal": ("license", "copyright"), "search": ("query", "ering"), "feed": ("tion", "heit"), "speech": ("que", "mente")},
    known_hosts=("example.com", "example.net", "example.org"),
    profiles={"com": (".com", "Com"), "net": (".net", "Net"), "org": (".org", "Org")},
)
