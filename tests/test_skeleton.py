import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.functions import skeleton

#: (language, source); rows that end in a mark are expected: F in functions only and both, T in types only and both,
#: A in all three modes.  A mark after ">" says where a cut row ends.
SOURCES = [
    (
        "go",
        """package demo

// Box holds things.//T
type Box struct {//T
	Name string//T
	size int // hidden
}//T

/* Opener opens. *///A
type Opener interface {//A
	Open()//F
	shut()
}//A

// NewBox makes a box.//F
func NewBox(//F
	name string,//F
) Box {//F
	return Box{Name: name}
}

func inner() {}
""",
    ),
    (
        "python",
        '''# Things


class Thing:#A
    """A thing."""#A

    kind = "x"#T
    _tag = 1

    def say(self):#F
        """Say it."""#F
        return "..."

    def _hidden(self):
        return 1


# makes one#F
@cached#F
def create(#F
    name: str,#F
    tag: str = "a",#F
) -> "Thing":#F
    # a comment in the body
    return Thing()


def _secret():
    return 0
''',
    ),
    (
        "typescript",
        """/** A shape. *///A
export interface Shape {//A
    area(): number;//F
    label: string; // shown//T
}//A

export class Dot {//A
    public x: number;//T
    private y: number;

    constructor(x: number) {//F
        this.x = x;
    }

    // Scales.//F
    public scale(f: number): Dot {//F
        if (f) { return this; }
        return new Dot(this.x * f);
    }

    private secret(): void {}
}//A

export const run = async (a: Req): Promise<void> => {//F
    return;
};
const limit = 3;
""",
    ),
    (
        "rust",
        """/// A user.//T
pub struct User {//T
    pub name: String,//T
    mail: String, // private
}//T

pub enum Role {//T
    Admin,//T
    Guest,//T
}//T

#[derive(Debug)]//A
pub trait Greet {//A
    fn greet(&self) -> String;//F
}//A

impl User {//A
    pub fn new(name: &'static str) -> Self {//F
        User { name: name.into(), mail: '{'.to_string() }
    }

    fn helper(&self) {}
}//A

fn private_fn() {}
""",
    ),
    (
        "java",
        """package x;

/** Sums. *///A
public class Calc {//A
    private int value;
    public static final int MAX = 100; // top//T

    @Override//F
    public int add(//F
        int x//F
    ) {//F
        return value + x;
    }

    private int secret() {
        return 42;
    }
}//A
""",
    ),
    (
        "c",
        """#include <x.h>
/* a point *///T
typedef struct Point {//T
    int x; /* the x *///T
} Point;//T

// Adds.//F
int add(int a, int b) {//F
    return a + b;
}

static int hid(void) { return 1; }
void greet(const char *name); // declared//F
""",
    ),
    (
        "cpp",
        """// A node.//A
class Node {//A
    int hidden;
public://A
    Node(int v);//F
    int value;//T
private:
    void drop();
};//A

template <typename T>//F
T most(T a, T b) {//F
    return a > b ? a : b;
}
""",
    ),
    (
        "csharp",
        """/// <summary>Sums.</summary>//A
public class Calc {//A
    private int value;
    public int Limit = 3;//T

    [Pure]//F
    public int Add(int x) {//F
        return value + x;
    }

    int Hidden() {
        return 1;
    }
}//A
""",
    ),
    (
        "kotlin",
        """// A box.//A
class Box(val name: String) {//A
    val size = 3//T
    private val key = 1

    fun open(): Int {//F
        return size
    }

    private fun shut() {
    }
}//A

fun free(a: Int): Int {//F
    return a
}
""",
    ),
    (
        "swift",
        """/// A box.//A
public struct Box {//A
    let name: String//T
    private var key = 1

    func open() -> Int {//F
        return 1
    }

    fileprivate func shut() {
    }
}//A
""",
    ),
    (
        "scala",
        """// A box.//A
class Box(name: String) {//A
  val size = 3//T
  private val key = 1

  def open(x: Int): Int = {//F
    x + 1
  }

  private def shut(): Unit = {
  }
}//A
""",
    ),
    (
        "php",
        """<?php
// A box.//A
class Box {//A
    public $name;//T
    private $key;

    public function open($x) {//F
        return $x;
    }

    private function shut() {
    }
}//A

function free($a) {//F
    return $a;
}
""",
    ),
    (
        "dart",
        """/// A box.//A
class Box {//A
  String name = '';//T
  int _key = 1;

  int open(int x) {//F
    return x;
  }

  void _shut() {
  }
}//A
""",
    ),
    (
        "groovy",
        """// A box.//A
class Box {//A
    String name//T
    private int key

    int open(int x) {//F
        return x
    }

    private void shut() {
    }
}//A
""",
    ),
    (
        "javascript",
        """// Adds.//F
export function add(a, b) {//F
    return a + b;
}

class Box {//A
    #key = 1;
    name = "x";//T
    open() {//F
        return this.name;
    }
}//A
""",
    ),
    (
        "zig",
        """/// Adds.//F
pub fn add(a: i32, b: i32) i32 {//F
    return a + b;
}

fn hidden() void {
}
""",
    ),
    (
        "ruby",
        """# A box#A
class Box#A
  attr_reader :name#T

  # Opens#F
  def open(x)#F
    x
  end

  private

  def shut
  end
end#A
""",
    ),
    (
        "haskell",
        """module M where

-- | A box#T
data Box = Box#T
  { name :: String#T
  }#T

-- | Opens#F
open :: Box -> String#F
open b = name b
""",
    ),
    (
        "ocaml",
        """(* A box *)//T
type box = {//T
  name : string;//T
}//T

(* Opens *)//F
let openb x =//F
  x.name

let limit = 3
""",
    ),
    (
        "objectivec",
        """// A box.//A
@interface Box : NSObject//A
@property NSString *name;//T
- (void)open;//F
@end//A
""",
    ),
]
MODES = {(True, False): "FA", (False, True): "TA", (True, True): "FTA"}


def marked(source: str):
    plain, marks = [], []
    for line in source.split("\n"):
        for sign in ("//", "#"):
            if line[-3:] in {sign + m for m in "FTA"} or line[-2:] in {sign + m for m in "FTA"}:
                marks.append(line[-1])
                plain.append(line[: -len(sign) - 1])
                break
        else:
            marks.append("")
            plain.append(line)
    return "\n".join(plain), marks


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("language, source", SOURCES, ids=[s[0] for s in SOURCES])
def test_languages(language, source, mode):
    text, marks = marked(source)
    want = [line for line, m in zip(text.split("\n"), marks) if m and m in MODES[mode]]
    got = [line for line in skeleton.skeleton_text(language, text, *mode).split("\n") if line != "..."]
    assert got == [*want, ""]


def test_one_line_bodies_are_cut_and_gaps_marked():
    text = 'package a\n\nfunc (b Box) Show() string { return "}" }\n\nfunc Two() {\n\treturn\n}\n'
    assert skeleton.skeleton_text("go", text, True, False) == "func (b Box) Show() string {\n...\nfunc Two() {\n"
    assert skeleton.skeleton_text("python", "def f(): return 1\n\ndef g():\n    pass\n", True, False) == "def f():\n...\ndef g():\n"


def test_comments_and_strings_do_not_count():
    text = 'func A() {\n\ts := "} func B() {"\n\t// } func C() {\n\tr := `\n}`\n}\n\nfunc D() {}\n'
    assert skeleton.skeleton_text("go", text, True, False) == "func A() {\n...\nfunc D() {\n"
    text = 'int a() {\n  auto s = R"x(} int b() { )x";\n  char c = \'{\';\n}\nint d() {\n}\n'
    assert skeleton.skeleton_text("cpp", text, True, False) == "int a() {\n...\nint d() {\n"


def test_what_cannot_be_read_stays_whole():
    for language, text in (("python", "def f(:\n"), ("go", "func A() {\n"), ("cobol", "x\n"), ("go", "")):
        assert skeleton.skeleton_text(language, text) in (text, "")
    assert skeleton.skeleton_rows("go", "func A() {}", False, False) is None


def test_c_headers_may_be_cpp():
    text = "class A {\npublic:\n    void f();\n};\n"
    assert "void f();" in skeleton.skeleton_text("c", text, True, False, "a.h")


def test_merged_ranges():
    assert skeleton.merged([(5, 7, 0), (0, 2, 0), (2, 3, 4), (3, 4, 0)]) == [(0, 3, 4), (3, 4, 0), (5, 7, 0)]
    assert skeleton.merged([(0, 5, 0), (1, 2, 3)]) == [(0, 5, 0)]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(skeleton.SUPPORTED), st.lists(st.sampled_from(["class A {", "}", "func F() {", "x = 1;", "\n", "//c\n", "/*", "*/", '"', "'", "def f():\n", "  ", "(", ")", "pub fn a()", "@x", "end\n", ",", "enum E {"]), max_size=40))
def test_any_text_gives_rows_in_order(language, parts):
    text = "".join(parts)
    for mode in MODES:
        ranges = skeleton.skeleton_rows(language, text, *mode)
        last = 0
        for start, end, cut in ranges or ():
            assert last <= start < end <= text.count("\n") + 1 and cut >= 0
            last = end


def test_rows(spark):
    rows = [("a.py", "python", "def f():\n    return 1\n"), ("b.txt", "text", "x"), ("c.go", "go", None)]
    got = {x["path"]: (x["skeleton"], x["skeleton_mode"]) for x in skeleton.skeletons(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert got == {"a.py": ("def f():\n", "definitions"), "b.txt": (None, None), "c.go": (None, None)}
