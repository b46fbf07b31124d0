"""The land-cover category dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.functions.codes import category_level, category_parent, category_short

#: Category codes and names.
CATEGORY_NAMES = """
0100 耕地; 0110 水田; 0120 旱地
0200 园地; 0210 果园; 0211 乔灌果园; 0212 藤本果园; 0213 草本果园; 0220 茶园; 0230 桑园; 0240 橡胶园; 0250 苗圃; 0260 花圃; 0290 其他园地; 0291 其他乔灌园地; 0292 其他藤本园地; 0293 其他草本园地
0300 林地; 0310 乔木林; 0311 阔叶林; 0312 针叶林; 0313 针阔混交林; 0320 灌木林; 0321 阔叶灌木林; 0322 针叶灌木林; 0323 针阔混交灌木林; 0330 乔灌混合林; 0340 竹林; 0350 疏林; 0360 绿化林地; 0370 人工幼林; 0380 稀疏灌丛
0400 草地; 0410 天然草地; 0411 高覆盖度草地; 0412 中覆盖度草地; 0413 低覆盖度草地; 0420 人工草地; 0421 牧草地; 0422 绿化草地; 0423 固沙灌草; 0424 护坡灌草; 0429 其他人工草地
0500 房屋建筑（区）; 0510 多层及以上房屋建筑区; 0511 高密度多层及以上房屋建筑区; 0512 低密度多层及以上房屋建筑区; 0520 低矮房屋建筑区; 0521 高密度低矮房屋建筑区; 0522 低密度低矮房屋建筑区; 0530 废弃房屋建筑区; 0540 多层及以上独立房屋建筑; 0541 多层独立房屋建筑; 0542 中高层独立房屋建筑; 0543 高层独立房屋建筑; 0544 超高层独立房屋建筑; 0550 低矮独立房屋建筑
0600 道路; 0601 路面; 0610 铁路; 0620 公路; 0630 城市道路; 0640 乡村道路
0700 构筑物; 0710 硬化地表; 0711 广场; 0712 露天体育场; 0713 停车场; 0714 停机坪与跑道; 0715 硬化护坡; 0716 场院; 0717 露天堆放场; 0718 碾压踩踏地表; 0719 其他硬化地表; 0720 水工设施; 0721 堤坝; 0722 闸; 0723 排灌泵站; 0729 其它水工构筑物; 0730 交通设施; 0731 隧道; 0732 桥梁; 0733 码头; 0734 车渡; 0735 高速公路出入口; 0736 加油（气）、充电站; 0740 城墙; 0750 温室、大棚; 0760 固化池; 0761 游泳池; 0762 污水处理池; 0763 晒盐池; 0769 其他固化池; 0770 工业设施; 0780 沙障; 0790 其他构筑物
0800 人工堆掘地; 0810 露天采掘场; 0811 露天煤矿采掘场; 0812 露天铁矿采掘场; 0813 露天铜矿采掘场; 0814 露天采石场; 0815 露天稀土矿采掘场; 0819 其他采掘场; 0820 堆放物; 0821 尾矿堆放物; 0822 垃圾堆放物; 0829 其他堆放物; 0830 建筑工地; 0831 拆迁待建工地; 0832 房屋建筑工地; 0833 道路建筑工地; 0839 其他建筑工地; 0890 其他人工堆掘地
0900 荒漠与裸露地表; 0910 盐碱地表; 0920 泥土地表; 0930 沙质地表; 0940 砾石地表; 0950 岩石地表
1000 水域; 1001 水面; 1010 河渠; 1011 河流; 1012 水渠; 1020 湖泊; 1030 库塘; 1031 水库; 1032 坑塘; 1040 海面; 1050 冰川与常年积雪; 1051 冰川; 1052 常年积雪
1100 地理单元; 1110 行政区划与管理单元; 1111 国家级行政区; 1112 省级行政区; 1113 特别行政区; 1114 地、市、州级行政区; 1115 县级行政区; 1116 乡、镇行政区; 1117 行政村; 1118 城市中心城区; 1119 其他特殊行政管理区; 1120 社会经济区域单元; 1121 主体功能区; 1122 开发区、保税区; 1123 国有农、林、牧场; 1124 自然、文化保护区; 1125 自然、文化遗产; 1126 风景名胜区、旅游区; 1127 森林公园; 1128 地质公园; 1129 行、蓄、滞洪区; 1130 自然地理单元; 1131 流域; 1132 地形分区; 1133 地貌类型单元; 1134 湿地保护区; 1135 沼泽区; 1140 城镇综合功能单元; 1141 居住小区; 1142 工矿企业; 1143 单位院落; 1144 休闲娱乐、景区; 1145 体育活动场所; 1146 名胜古迹; 1147 宗教场所
1200 地形; 1210 高程信息; 1220 坡度信息; 1230 坡向信息
"""

NAMES = dict(part.strip().split(" ", 1) for line in CATEGORY_NAMES.strip().split("\n") for part in line.split(";"))
ADMINISTRATIVE = {"1112": 1, "1114": 2, "1115": 3}  # unit categories that are districts, and their level


def category_dimension(spark: SparkSession) -> DataFrame:
    """code, name, level, short, parent."""
    rows = spark.createDataFrame(sorted(NAMES.items()), "code string, name string")
    return rows.select("code", "name", category_level("code").alias("level"), category_short("code").alias("short"), category_parent("code").alias("parent"))


def region_dimension(counties: DataFrame, code: str = "code") -> DataFrame:
    """county, city, province of a table of 6-digit county codes."""
    county = F.col(code)
    return counties.select(county.alias("county"), F.rpad(F.substring(county, 1, 4), 6, "0").alias("city"), F.rpad(F.substring(county, 1, 2), 6, "0").alias("province"))


def province_ranges(regions: DataFrame) -> DataFrame:
    """For each province its number of counties and how many counties come before it in code order."""
    counts = regions.groupBy("province").agg(F.count("*").alias("counties"))  # a row for each province
    before = F.sum("counties").over(Window.orderBy("province").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("province", "counties", F.coalesce(before, F.lit(0)).alias("start"))


def names_below(code: str) -> str:
    """The names of a category and all below it, as words for a keyword query."""
    short = "" if code == "0000" else code[:2] if code.endswith("00") else code[:3] if code.endswith("0") else code
    return " ".join(name for c, name in sorted(NAMES.items()) if c.startswith(short))
