"""Common source kinds, a list of our own: extensions in lower case, file names and interpreters of scripts; and the reader of a
file that lists others."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Kinds:
    """Extensions in lower case without their dot, file names, and interpreters of scripts that make a file a source."""

    extensions: list[str]
    names: list[str]
    interpreters: list[str]


def load(path: str) -> Kinds:
    """The kinds that a language list names: a YAML file with a mapping for each language, and in it lists of `extensions`,
    `filenames` and `interpreters`, one item a line. Extensions lose their first dot and count in small letters."""
    found: dict[str, dict[str, None]] = {"extensions": {}, "filenames": {}, "interpreters": {}}
    now = None
    with open(path, encoding="utf-8") as f:
        for line in f:
            if key := re.match(r"\s+([\w-]+):\s*(?:#.*)?$", line):
                now = found.get(key[1])
            elif item := re.match(r"\s*-\s+(.*?)\s*$", line):
                if now is not None:
                    text = item[1]
                    text = text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text.split(" #")[0].strip()
                    now[text.removeprefix(".").lower() if now is found["extensions"] else text] = None
            elif line.strip() and not line.lstrip().startswith("#"):
                now = None
    return Kinds(list(found["extensions"]), list(found["filenames"]), list(found["interpreters"]))


EXTENSIONS = """
rs py js jsx ts tsx mjs cjs go c h cc cpp cxx hpp java kt scala sc rb php swift hs lua nix zig cs sh bash sql html css json toml yaml yml xml md txt
mts cts es6 vue svelte astro coffee litcoffee iced ls elm purs re rei res resi mint imba marko riot
pyi pyx pxd pxi pyw pyp ipynb rpy wsgi sage star bzl bazel bxl gyp gypi tac
c++ h++ hh hxx inl ino ipp tcc tpp ixx cppm idc m mm cu cuh cl opencl ispc x xs xsp w re2c y yy l ll lex yacc jison jisonlex
rlib ron pest lalrpop dart d di nim nimble nims nimrod cr v vv vh sv svh vhd vhdl vhi vho hdl chisel odin jai c3 c3i carbon mojo gleam roc grain wren pony hx hxsl vala vapi
csx cake cshtml razor vb vbs bas cls frm vba vbhtml fs fsi fsx fsscript xaml csproj fsproj vbproj vcxproj props targets sln nuspec resx
kts ktm groovy gvy grt gtpl gradle jsp jspx jspf jsf tag tld sbt clj cljs cljc cljx edn bb hic boot hl
rbx rbw rake gemspec ru builder jbuilder podspec thor watchr ruby erb rhtml haml slim liquid mustache hbs handlebars
php3 php4 php5 phps phpt phtml inc ctp twig blade latte tpl smarty
pl pm pod t ph plx al psgi cgi fcgi raku rakumod rakutest p6 pl6 pm6 nqp
r rd rsx rmd qmd rnw jl mat mlx nb wl wls wlt mathematica sas do ado doh ihlp matah sps stan jags bugs
ex exs eex heex leex erl hrl es escript xrl yrl app.src lfe
lhs hsc hs-boot cabal dhall agda lagda idr lidr lean hlean thy v8 coq ml mli mll mly eliom eliomi ocaml ml4 mlp sml sig fun fnc sl
lisp lsp cl asd asdf el emacs emacs.desktop scm sch sld sls sps rkt rktd rktl scrbl ss fnl hy janet jnl arc
asm a51 s ms nasm inc65 wat wast wasm mlir tbl td
f f77 f90 f95 f03 f08 for fpp ada adb ads pas dpr dfm lpr pp lfm cob cbl ccp cobol cpy bas8 b bf apl dyalog j ijs k q p abap as asp aspx ascx asax ashx asmx cfm cfml cfc
zsh ksh fish csh tcsh bats command tmux nu elv xsh ebuild eclass ps1 psm1 psd1 ps1xml bat cmd ahk ahkl au3 nsi nsh iss isl applescript scpt vim vimrc vmb
awk auk gawk mawk nawk sed tcl adp tm itcl exp expect rexx pprx rex
prc plsql pls pkb pkg pks plb bdy ddl dml tab udf viw cql cypher cyp hql pig sparql rq graphql gql graphqls prql kql surql dbml db2 mysql pgsql tsql
htm xht xhtml html.hl shtml svg xsl xslt xsd wsdl rng rnc dtd xul xquery xq xql xqm xqy xproc xpl xmi rdf owl ttl n3 nt nq trig jsonld rss atom plist storyboard xib
scss sass less styl stylus pcss postcss sss
jsonc json5 jsonl geojson topojson gltf webmanifest webapp har avsc tfstate mcmeta tmlanguage
ini cfg conf cnf config prefs pro properties desktop service socket timer mount target slice env dotenv editorconfig lock reg inf hcl tf tfvars nomad workflow bicep jsonnet libsonnet cue kdl ncl pkl rego sentinel pp puppet sls
proto thrift capnp avdl fbs asn asn1 smithy tsp wit idl webidl aidl bond slice
md2 markdown mdown mdwn mdx mkd mkdn mkdown ronn livemd rst rest adoc asciidoc asc org textile creole mediawiki wiki tex ltx sty cls dtx bib bst aux lbx bbx cbx ins mkii mkiv mkvi toc typ pod6 rdoc man 1 2 3 4 5 6 7 8 9 roff mdoc me nr texi texinfo txi
po pot srt vtt ics vcf csv tsv psv
mk mak make mkfile cmake ninja gn gni bb bbclass bbappend recipe just am ac m4 in spec dockerfile containerfile earth meson jam wsf
glsl vert frag geom tesc tese comp fp frg fs fsh fshader gs gshader glslf glslv rchit rmiss rgen vrx vsh vshader hlsl hlsli fx fxh cginc shader compute metal wgsl slang gd gdshader tscn tres godot unity prefab asset mat anim meta usda
sol vy cairo move clar teal fe yul tact nr circom
matlab scad openscad gcode g ngc kicad_pcb kicad_mod kicad_sch sch brd ucf xdc sdc cir net sp ino pde
feature story robot cy sublime-build sublime-keymap sublime-settings tmpreferences snippet
dot gv puml plantuml iuml mmd mermaid gp gnu gnuplot plot plt pgf ly ily abc ck csd orc sco sc scd pd maxpat
diff patch http rest hurl ebnf abnf bnf peg pegjs peggy g4 g ne ungram ql qll st
lean4 red reds reb r2 r3 rebol io ioke factor forth fth 4th f frt ps eps epsi pfa moon pluto luau rockspec nse p8 wlua terra lookml lkml dax pq
applescript oz opa ooc oxygene oxh ox nl nit ni i7x nu nut mod mo mod2 def m2 m3 i3 ig e eiffel ec eh boo brs bro zeek zep ceylon ch chpl cirru clp clean icl dcl click clw cp cps ecl ecr em emberscript ftl kit kid mako mao jinja jinja2 j2 njk soy jade pug dust eco ejs ect jst tea vm volt
hack hhi hack logtalk lgt mercury moo muf mumps myt ncl nbp pan pasm pir parrot pike pmod pogo ring rg rs.in sp sma sqf hqf stata swig uc ur urs vhost webppl x10 xc xojo_code xtend yang yar yara zil zimpl zmpl zpl
""".split()

NAMES = """
Makefile makefile GNUmakefile BSDmakefile Kbuild Makefile.am Makefile.in Makefile.inc Makefile.boot Makefile.PL makefile.sco mkfile
Dockerfile Containerfile Earthfile Rakefile rakefile Gemfile Gemfile.lock Guardfile Podfile Thorfile Vagrantfile Capfile Berksfile Brewfile Buildfile Dangerfile Fastfile Appfile Deliverfile Snapfile Puppetfile Appraisals Cheffile Steepfile .irbrc .pryrc .simplecov buildfile mcmod.info
CMakeLists.txt Jenkinsfile Justfile justfile .justfile JUSTFILE Procfile Caddyfile Tiltfile Snakefile SConstruct SConscript Sconstruct wscript BUILD BUILD.bazel WORKSPACE WORKSPACE.bazel MODULE.bazel BUCK DEPS Jamfile Jakefile Cakefile Gulpfile Gruntfile meson.build meson_options.txt configure.ac
go.mod go.sum go.work go.work.sum Cargo.lock Cargo.toml.orig Pipfile Pipfile.lock poetry.lock pdm.lock uv.lock requirements.txt pylintrc .pylintrc .flake8 .coveragerc composer.lock package-lock.json yarn.lock deno.lock flake.lock mix.lock rebar.config rebar.config.lock rebar.lock Emakefile
.bashrc .bash_profile .bash_login .bash_logout .bash_aliases .bash_functions .profile .zshrc .zshenv .zprofile .zlogin .zlogout .kshrc .cshrc .tcshrc .login .inputrc .tmux.conf .vimrc .gvimrc .nvimrc _vimrc vimrc gvimrc .exrc .emacs .spacemacs .gnus .viper _emacs PKGBUILD APKBUILD bashrc zshrc zshenv zprofile profile login cshrc
.editorconfig .gitignore .gitattributes .gitmodules .gitconfig .mailmap .dockerignore .npmignore .eslintignore .prettierignore .npmrc .yarnrc .curlrc .wgetrc .htaccess .clang-format .clang-tidy .clangd .babelrc .eslintrc .eslintrc.json .jshintrc .jslintrc .jscsrc .swcrc .prettierrc .stylelintrc .env .env.example .env.local .luacheckrc .latexmkrc latexmkrc .perlcriticrc .perltidyrc .Rprofile .scalafix.conf .scalafmt.conf .swift-format .tern-project .watchmanconfig .devcontainer.json .nanorc .dircolors .ackrc .gemrc .ctags
README LICENSE COPYING INSTALL NEWS CHANGELOG AUTHORS NOTICE HACKING TODO README.1ST read.me CODEOWNERS robots.txt hosts nginx.conf apache2.conf httpd.conf Kconfig Modulefile Doxyfile Project.toml Manifest.toml ROOT Notebook Nukefile Phakefile Singularity Slakefile Lexer.x Expr-dist fp-lib-table sym-lib-table contents.lr
""".split()

INTERPRETERS = """
python python2 python3 bash sh zsh node ruby perl php lua deno tclsh awk
ash dash ksh mksh pdksh csh tcsh fish rc nu elvish xonsh bats pypy pypy3 jython ipython sage micropython uv nodejs bun tsx ts-node qjs d8 gjs js rhino coffee lsc iojs v8 v8-shell chakra
jruby macruby rake rbx truffleruby raku rakudo perl6 cperl hhvm hack luajit luau texlua moon gawk mawk nawk sed gsed minised ssed wish expect tcl
Rscript julia octave matlab gnuplot groovy kotlin scala sbt java jshell clojure bb lein racket guile guile2 gosh csi chicken chez scheme sbcl clisp ccl ecl lisp hy fennel janet emacs
ocaml ocamlrun ocamlscript runhaskell runghc runhugs stack sml elixir iex escript erl swift swipl yap dart crystal nim nimrun rdmd dmd go gorun gsh rust-script cargo zig tcc pwsh powershell fsharpi dotnet dotnet-script scriptcs make gmake just ninja osascript vim nvim apl aplx dyalog jconsole parrot pike pil picolisp io regina rexx nush bc dc gdb jq m4 eui euiexec newlisp lfe instantfpc openrc-run asy stap bpftrace dtrace nextflow jolie nit oz ring rune haxe nix-shell tmux env
""".split()
