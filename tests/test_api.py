from shelfsense.plans.assortment import Assortment
from shelfsense.plans import catalog as K


def test_assortment_class(spark):
    with Assortment(K.sales_of(spark, "/root/testdata/sf0.001"), n=3, tail=0.1) as a:
        top = a.cluster_top()
        assert top.where("rank > 3").count() == 0 and top.where("rank = 3").count() > 0
        keys = ["property_code", "category_name", "transaction_month"]
        add = a.stocking_suggestions()
        stores = a.store_ranking().select(*keys).distinct().count()
        # every store-category-period has suggestions or sells the whole list
        assert add.select(*keys).distinct().count() + a.already_stocking_top().count() == stores
        assert add.where("cluster_rank > 3").count() == 0
        assert a.report().where("section = 0").count() == stores
        missing = a.no_sales_categories()
        assert missing.where("size(categories) = 0").count() == 0
        assert a.price_summary().count() > 0
        by_cluster = a.price_optimum(keys=("description", "cluster"))
        assert by_cluster.select("cluster").distinct().count() > 1
        one = a.price_points(cluster=0, month="1996")
        sold = a.sales.where("cluster = 0 AND transaction_month = '1996'")
        assert one.select("description").distinct().count() == sold.select("description").distinct().count() > 0
