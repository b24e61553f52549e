from pyspark.sql import functions as F

from tessera.functions.rules import dao_reason

CASES = [
    ("src/a/B.xml", "class UserDao {}", "not_source"),
    ("src/dao/Plain.java", "class Plain {}", "path"),
    ("src/x/UserDAOImpl.java", "class UserDAOImpl {}", "path"),
    ("src/x/Users.java", "public class UserRepository { }", "class_name"),
    ("src/x/Users.java", "public class Users extends BaseMapper { }", "superclass"),
    ("src/x/A.java", "class A { void f() { org.hibernate.Session.open(); } }", "library_call"),
    ("src/x/A.java", "class A { void f() { return preparedStatement; } }", "jdbc_member"),
    ("src/x/A.java", "class A { void f() throws IOException, SQLException { } }", "throws_sql"),
    ("src/x/A.java", "@Repository class A { }", "none"),
    ("src/x/A.java", "class A { }", "none"),
    ("src/x/A.java", "class A { } // calls getConnection later", "none"),
    ("src/x/A.java", "class A { void f() { g.prepareStatement(sql); } }", "none"),
    ("src/x/A.java", "/* class UserMapper */ class A { }", "none"),
    ("src/x/A.java", 'class A { String s = "class FooDao"; }', "none"),
    ("src/x/A.java", "class A { Object resultSetConnection = x; }", "jdbc_member"),
]


def test_rule_order(spark):
    df = spark.createDataFrame(CASES, "path string, content string, want string")
    got = df.select("want", dao_reason(F.col("path"), F.col("content")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_annotation_rule_when_enabled(spark):
    df = spark.createDataFrame([("A.java", "@Repository class A { }")], "path string, content string")
    r = df.select(dao_reason(F.col("path"), F.col("content"), match_annotations=True)).first()[0]
    assert r == "annotation"
